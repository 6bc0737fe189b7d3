"""The queries of this subpackage and their SQL twins; __spark_entry__ registers both, and the pipeline beside them."""

from __future__ import annotations

from . import langid, licenses, line_dedup, mixing, pieces, quality, simhash, substrings, vectors, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1,
    "op2_simhash": simhash.op2,
    "op3_vectors": vectors.op3,
    "op4_licenses": licenses.op4,
    "op5_warc": warc.op5,
    "op6_langid": langid.op6,
    "op7_substrings": substrings.op7,
    "op8_pieces": pieces.op8,
    "op9_mixing": mixing.op9,
    "op10_quality": quality.op10,
}
ORACLE = {"op1_line_dedup": line_dedup.OP1_SQL, "op5_warc": warc.OP5_SQL}
