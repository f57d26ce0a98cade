"""The token files' footers: codings, row groups and indexes, and what a filter leaves unread."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from latticework.llm import tokens

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.repeat("text", 4).alias("text"))  # enough ids for several row groups
    tokens.write_tokens(docs, path, row_group_bytes=256 << 10, page_bytes=16 << 10)
    return path


def chunks(path):
    for file in sorted(Path(path, "tokens").glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            yield file, g, {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}


def test_codings(written):
    """Token ids by dictionary, ascending and counted columns by deltas, everything with column and page indexes."""
    seen = 0
    for _, _, columns in chunks(written):
        ids = columns["tokens.list.element"]
        assert ids.has_dictionary_page and {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(ids.encodings)
        for name in ("doc_id", "part_start", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings and not columns[name].has_dictionary_page
        assert all(c.has_column_index and c.has_offset_index and c.compression == "ZSTD" for c in columns.values())
        seen += 1
    assert seen > len(list(Path(written, "tokens").glob("*.parquet")))  # several row groups in a file


def test_row_groups_are_small_and_in_order(written):
    last = None
    for file, _, columns in chunks(written):
        stats = columns["doc_id"].statistics
        assert sum(c.total_uncompressed_size for c in columns.values()) < 4 * (256 << 10)  # sizes are looked at every hundred rows
        assert last is None or last[0] != file or last[1] <= stats.min
        last = file, stats.max


def test_a_filter_leaves_the_rest_unread(spark, written):
    """Row groups whose ids lie elsewhere are skipped by their statistics; lengths alone are read without ids."""
    whole = tokens.read_tokens(spark, written)
    one = whole.filter("doc_id = 500").select("n_tokens")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,500)" in plan and "tokens:array" not in plan
    fits = [1 for _, _, c in chunks(written) if c["doc_id"].statistics.min <= 500 <= c["doc_id"].statistics.max]
    assert 1 <= len(fits) < len(list(chunks(written)))
    assert one.count() == 1
    lengths = tokens.read_tokens(spark, written, ("doc_id", "n_tokens"))
    assert "tokens:array" not in lengths._jdf.queryExecution().executedPlan().toString() and lengths.count() == 1000
