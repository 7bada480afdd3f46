"""The pipeline against a brute-force version of its stages, and its contract."""

import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from ruleharbor.llm import decontaminate, mixing, quality
from ruleharbor.llm.common import table
from tests.llm.test_dedup import classes_by_hand, print_by_hand, squeezed
from tests.llm.test_mixing import count_by_hand, unit

SF = "/root/testdata/sf0.001"


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mix"]


def test_run_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    good = {r.doc_id for r in quality.score(docs, table(spark, SF, "labels")).where("__predicted = 1").collect()}
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect() if r.doc_id in good]
    first = {}
    for r in rows:
        first.setdefault(squeezed(r[1]), r)
    rows = sorted(first.values())
    classes = classes_by_hand(rows, [print_by_hand(r[1]) for r in rows])
    stay = {c[0] for c in classes if c[0] == c[2]}
    rows = [r for r in rows if r[0] in stay]
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in table(spark, SF, "benchmark").collect()]
    grams = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in items]

    def leaks(text):
        words = re.findall(r"[^\W_]+", text.lower())
        have = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
        return any(len(g & have) > 0.5 * len(g) for g in grams)

    rows = [r for r in rows if not leaks(r[1])]
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1]) + 1
    weight = {s: n ** mixing.POWER for s, n in size.items()}
    want = Counter()
    for r in rows:
        rate = weight[r[3]] / sum(weight.values()) * sum(size.values()) / size[r[3]]
        want[r[0]] = count_by_hand(unit(f"{mixing.SEED}:{r[0]}"), rate)
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == docs.columns
    got = Counter({r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()})
    assert got == Counter({k: v for k, v in want.items() if v})


def test_stages_keep_columns_and_take_empty_tables(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert name == "mix" or out.count() <= docs.count()
    assert decontaminate.drop_contaminated(odd.withColumn("item_id", F.lit(1)), table(spark, SF, "benchmark")).columns[-1] == "item_id"
