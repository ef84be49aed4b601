"""The queries of this subpackage, by name: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from .common import table


def op1_quality_rules(spark, sf_dir):
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op2_simhash_vptree(spark, sf_dir):
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_kneser_ney(spark, sf_dir):
    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"), order=3)


def op5_language_id(spark, sf_dir):
    from .langid import predict_documents

    return predict_documents(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    from .decontam import digest

    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc_revisits(spark, sf_dir):
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark, sf_dir):
    from .suffix import digest

    return digest(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark, sf_dir):
    from .pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    from .tokens import count_documents

    return count_documents(table(spark, sf_dir, "documents"))


def op11_bpe_transducer(spark, sf_dir):
    from .bpe import digest

    return digest(table(spark, sf_dir, "documents"))


def op12_kmeans(spark, sf_dir):
    from .kmeans import digest

    return digest(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark, sf_dir):
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_simhash_vptree, op3_license_scan, op4_kneser_ney, op5_language_id, op6_decontamination, op7_warc_revisits, op8_suffix_dedup, op9_sentencepiece, op10_token_counts, op11_bpe_transducer, op12_kmeans, op13_lexical_search, pipeline)}
