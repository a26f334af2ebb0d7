"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import decontam, hilbert, hmm, kmeans_tree, linededup, nbsvm, pieces, simhash, suffixes, url_cascade

QUERIES = {
    "op1_url_cascade": url_cascade.op1,
    "op2_kmeans_tree": kmeans_tree.op2,
    "op3_hidden_markov": hmm.op3,
    "op4_nb_svm": nbsvm.op4,
    "op5_spaced_seeds": decontam.op5,
    "op6_anchor_simhash": simhash.op6,
    "op7_fuzzy_lines": linededup.op7,
    "op8_hilbert_shards": hilbert.op8,
    "op9_streaming_viterbi": pieces.op9,
    "op10_difference_cover": suffixes.op10,
}
ORACLES = {"op1_url_cascade": url_cascade.SQL1}
