"""Queries against their DuckDB oracles on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lapwing.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["t01_t02_tokens", "t04_t12_segment_tests", "t08_mostly_common", "g02_sentence_spans", "g05_paragraphs", "x01_shingles", "x04_containment", "x06_x08_verbatim_runs", "c03_distinctive_phrases", "b01_b02_structure", "r11_visible", "e02_current_state", "q01_q02_quality", "f01_f04_fuzzy", "v01_v03_semantic", "w08_w09_style_verdict", "b05_b08_citation_issues", "c01_keyword_retrieval", "b03_b04_citation_sets", "g02_span_flags", "c06_c12_peers", "c14_capped", "a01_a05_alignments", "a09_a12_overlap_by_scope", "a13_a22_matches", "a14_a23_comparisons", "a18_a20_reports"]


def canonical(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted([tuple(None if pd.isna(v) else f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df.itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
