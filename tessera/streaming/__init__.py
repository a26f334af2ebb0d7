"""Incremental delivery of results: cursors that fetch one partition at a time, and their asynchronous form."""

from __future__ import annotations

import asyncio
import uuid
from collections.abc import AsyncIterator, Iterator

from pyspark.sql import DataFrame, Row

from ..errors import BadArgs


class Cursor:
    """Rows of a DataFrame as they come; while a partition is read, the next one is computed."""

    def __init__(self, df: DataFrame):
        self.df, self.tag = df, f"cursor-{uuid.uuid4().hex}"
        self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema]
        self.rowcount = -1  # known once all rows are fetched
        self._rows: Iterator[Row] | None = None
        self._seen, self._closed = 0, False

    def _next(self) -> Row | None:
        if self._closed:
            raise BadArgs("the cursor is closed")
        if self._rows is None:
            spark = self.df.sparkSession
            spark.addTag(self.tag)
            try:
                self._rows = self.df.toLocalIterator(prefetchPartitions=True)
            finally:
                spark.removeTag(self.tag)
        row = next(self._rows, None)
        if row is None:
            self.rowcount = self._seen
        else:
            self._seen += 1
        return row

    def fetchone(self) -> Row | None:
        return self._next()

    def fetchmany(self, size: int = 1000) -> list[Row]:
        out: list[Row] = []
        while len(out) < size and (row := self._next()) is not None:
            out.append(row)
        return out

    def fetchall(self) -> list[Row]:
        return list(self)

    def __iter__(self) -> Iterator[Row]:
        while (row := self._next()) is not None:
            yield row

    def close(self) -> None:
        """Give up the rest; jobs that still run for it are interrupted."""
        if not self._closed and self._rows is not None and self.rowcount < 0:
            self.df.sparkSession.interruptTag(self.tag)
        self._closed, self._rows = True, None

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class AsyncCursor:
    """The same, without blocking the event loop."""

    def __init__(self, cursor: Cursor):
        self.cursor = cursor
        self.description = cursor.description

    async def fetchone(self) -> Row | None:
        return await asyncio.to_thread(self.cursor.fetchone)

    async def fetchmany(self, size: int = 1000) -> list[Row]:
        return await asyncio.to_thread(self.cursor.fetchmany, size)

    async def fetchall(self) -> list[Row]:
        return await asyncio.to_thread(self.cursor.fetchall)

    async def __aiter__(self) -> AsyncIterator[Row]:
        while rows := await self.fetchmany():
            for row in rows:
                yield row

    async def close(self) -> None:
        await asyncio.to_thread(self.cursor.close)
