"""The registered queries of problems 6 to 8 and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import garble, leaks, packing
from graphloom.runtime import cut, table


def p6_pack(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p6_report(spark, d):
    return packing.fill_report(p6_pack(spark, d), table(spark, d, "context_windows"))


def p6_valid(spark, d):
    return packing.validity(p6_pack(spark, d), table(spark, d, "documents"), table(spark, d, "context_windows"))


def p6_reduced(spark, d):
    """What the dominance reduction alone fixes, for each window."""
    return packing.reduction_report(cut(packing.token_sizes(table(spark, d, "documents"))), table(spark, d, "context_windows"))


def p6_bounds(spark, d):
    """Of p6_report what doesn't depend on the tokenizer: one row for each window, its containers within the bounds."""
    texts = table(spark, d, "documents").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("words"))
    r = p6_report(spark, d).join(table(spark, d, "context_windows"), "window_id").crossJoin(F.broadcast(texts))  # one row
    ok = (F.col("n_tokens") <= F.col("bytes")) & (F.col("least") == F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))) & (F.col("least") <= F.col("n_containers"))
    return r.select("window_id", "capacity_tokens", ok.alias("within"), (F.col("filled") >= 0.99).alias("well_filled"))


def p6_found(spark, d):
    """Documents that come out of the packing in more than one piece for the largest window."""
    windows = table(spark, d, "context_windows")
    largest = windows.select(F.max_by("window_id", F.struct("capacity_tokens", "window_id")).alias("window_id"))
    return p6_pack(spark, d).where("piece = 1").join(F.broadcast(largest), "window_id", "left_semi").select("doc_id")


def p7_leaks(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark, d):
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_report(spark, d):
    return leaks.leak_report(p7_leaks(spark, d), table(spark, d, "eval_items"))


def p8_restored(spark, d):
    return garble.garbled_documents(table(spark, d, "documents"))


def p8_found(spark, d):
    return p8_restored(spark, d).select("doc_id")


QUERIES = {f.__name__: f for f in (p6_found, p6_pack, p6_report, p6_valid, p6_bounds, p6_reduced, p7_found, p7_leaks, p7_report, p8_found, p8_restored)}

_WINDOWS = """
w AS (SELECT {key} AS k, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS l FROM {table} WHERE text IS NOT NULL),
u AS (SELECT k, l, unnest(range(1, len(l) - 10)) AS i FROM w WHERE len(l) >= 12)
SELECT DISTINCT k, i, array_to_string(l[i:i + 11], ' ') AS run FROM u
"""
_RUNS = f"""d AS (WITH {_WINDOWS.format(key='doc_id', table='documents')}), e0 AS (WITH {_WINDOWS.format(key='item_id', table='eval_items')}), e AS (SELECT DISTINCT k, run FROM e0),
found AS (SELECT d.k AS doc_id, e.k AS item_id, count(*) AS n_runs, min(d.i) - 1 AS first_word FROM d JOIN e USING (run) GROUP BY 1, 2)"""

ORACLE: dict[str, str] = {
    # any of the tokenizers gives a token a word or more, and a token a byte or fewer: the data leave nothing between
    "p6_found": "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\\S+')) > (SELECT max(capacity_tokens) FROM context_windows)",
    "p6_valid": "SELECT window_id, (SELECT count(*) FROM documents) AS n_documents, 0 AS n_lost, 0 AS n_over, 0 AS n_twice, 0 AS n_needless, 0 AS n_unequal FROM context_windows",
    "p6_bounds": "SELECT window_id, capacity_tokens, true AS within, true AS well_filled FROM context_windows",
    "p7_found": f"WITH {_RUNS} SELECT doc_id, item_id FROM found",
    "p7_leaks": f"WITH {_RUNS} SELECT doc_id, item_id, n_runs, first_word FROM found",
    "p7_report": f"WITH {_RUNS} SELECT item_id, suite, count(*) AS n_docs, CAST(sum(n_runs) AS BIGINT) AS n_runs FROM found JOIN eval_items USING (item_id) GROUP BY item_id, suite",
}
