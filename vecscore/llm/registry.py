"""The registered queries of the corpus operators, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from vecscore.llm import ann, bpe, html, langid, lines, media, ngram_join, packing, toxicity, warc
from vecscore.llm.common import table


def op1_html(spark, sf_dir):
    """Main text of every page by its host's consensus path."""
    return html.extract(table(spark, sf_dir, "pages"))


def op2_ann(spark, sf_dir):
    """The 20 nearest rows of embeddings for each row whose id is divisible by 20."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op3_warc(spark, sf_dir):
    """Write all pages as WARC records and read the archives back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_langid(spark, sf_dir):
    """Language of every whole text of documents."""
    return langid.held_out_query(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    """Pack all documents into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    """Documents without the boilerplate lines of their source."""
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "source", "text", "n_lines", "n_dropped")


def op7_bpe(spark, sf_dir):
    """Encode and decode every whole text of documents."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op8_toxicity(spark, sf_dir):
    """Toxicity score of every whole text of documents."""
    return toxicity.held_out_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media(spark, sf_dir):
    """Store every whole text of documents as an image and read it back."""
    return media.store_documents(table(spark, sf_dir, "documents"), with_media=False)


def op10_ngram_join(spark, sf_dir):
    """Components of documents linked by five-word shingles at Jaccard 0.8."""
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_html, op2_ann, op3_warc, op4_langid, op5_packing, op6_line_dedup, op7_bpe, op8_toxicity, op9_media, op10_ngram_join)}


def oracle_sql():
    return {"op3_warc": warc.ORACLE, "op6_line_dedup": lines.ORACLE}
