"""A running task of op5 keeps one Python worker."""

import re

from gradebook.llm.substrings import repeated_substrings


def test_rows_without_spans_are_sifted_and_cut_by_one_worker(spark):
    text = "".join(f"{i * 7919 % 1009} " for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "x" + text), (3, "short"), (4, None)], "doc_id bigint, text string")
    found = repeated_substrings(docs)
    size = len(text)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept).decode()) for r in found.collect()) == [
        (1, size, 0, text), (2, size + 1, size, "x"), (3, 5, 0, "short"), (4, 0, 0, "")]
    # Rows with spans are sifted, joined and cut (a shuffle between them), the others sifted and cut at once.
    initial = found._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall("MapInArrow", initial)) == 3
