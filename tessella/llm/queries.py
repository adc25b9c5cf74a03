"""The thin opN queries: each applies its operator to its whole table."""

from __future__ import annotations

from .arc import warc_digest
from .common import table
from .linededup import line_dedup_digest
from .phraseindex import contamination_digest
from .oracles import ORACLES  # noqa: F401
from .piecefst import encoding_digest
from .quality import quality_digest
from .simhash import simhash_digest
from .tagpath import extraction_digest
from .toxicity import toxicity_digest
from .urlfilter import url_digest
from .vptree import nearest

QUERIES = {
    "op5_vp_tree": lambda spark, sf_dir: nearest(table(spark, sf_dir, "embeddings")),
    "op4_url_filter": lambda spark, sf_dir: url_digest(table(spark, sf_dir, "pages")),
    "op7_tag_path": lambda spark, sf_dir: extraction_digest(table(spark, sf_dir, "pages")),
    "op8_arc_to_warc": lambda spark, sf_dir: warc_digest(table(spark, sf_dir, "pages")),
    "op6_sentencepiece_fst": lambda spark, sf_dir: encoding_digest(table(spark, sf_dir, "documents")),
    "op1_toxicity_nnpu": lambda spark, sf_dir: toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_quality_random_indexing": lambda spark, sf_dir: quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op3_phrase_index": lambda spark, sf_dir: contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op2_simhash_golay": lambda spark, sf_dir: simhash_digest(table(spark, sf_dir, "documents")),
    "op10_line_dedup": lambda spark, sf_dir: line_dedup_digest(table(spark, sf_dir, "documents")),
}
