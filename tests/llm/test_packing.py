"""Packing: nothing lost, nothing split that fits, near the certified bound."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from amperelake.llm import packing


def fewest(sizes, capacity):
    """The true minimum by search, for a few items."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in {*range(len(bins))}:
            if bins[b] + sizes[i] <= capacity:
                bins[b] += sizes[i]
                go(i + 1, bins)
                bins[b] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_packing_enclose_the_minimum(sizes):
    s = sorted(sizes, reverse=True)
    low = packing.lower_bound(np.bincount(s, minlength=21), 20)
    bins, fill = packing.best_fit_decreasing(np.array(sizes), 20)
    assert low <= fewest(s, 20) <= len(fill)
    assert fill.max() <= 20 and [sum(x for x, b in zip(sizes, bins) if b == i) for i in range(len(fill))] == fill.tolist()


def test_every_token_once(spark):
    r = random.Random(1)
    docs = [(i, r.choice([0, 1, 5, 60, 99, 100, 101, 250, r.randint(1, 100)])) for i in range(3000)] + [(5000, None)]
    df = spark.createDataFrame(docs, "doc_id long, n_tokens int").selectExpr("*", "1 as part", "2 as bin", "3 as fill", "4 as gap")
    p = packing.pack(df, capacity=100, per_partition=300).cache()
    per = {x.doc_id: x.n for x in p.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert per == {i: n or 0 for i, n in docs}
    bins = p.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.first("fill").alias("f"))
    assert bins.where("n > 100 or n <> f").count() == 0
    assert p.where("piece > 0").select("doc_id").distinct().count() == sum((n or 0) > 100 for _, n in docs)
    spans = p.where("n_tokens > 0").orderBy("doc_id", "token_start").collect()
    assert all(a.doc_id != b.doc_id or a.token_start + a.n_tokens == b.token_start for a, b in zip(spans, spans[1:]))
    c = packing.certificate(p, 100).first()
    assert c.bound <= c.containers <= c.bound * 1.01 + 1
    assert p.where("container_id is null").count() == sum(not n for _, n in docs)


def test_documents_of_one_id_or_none_keep_to_themselves(spark):
    df = spark.createDataFrame([(7, 5000), (7, 5000), (None, 4096), (None, 4096), (None, 4096), (8, 30), (8, 30), (8, 30), (7, 0), (7, None)], "doc_id long, n_tokens int").repartition(3)
    p = packing.pack(df).cache()
    bins = p.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.max("fill").alias("f"))
    assert bins.where("n > 2048 or n <> f").count() == 0
    assert p.agg(F.sum("n_tokens")).first()[0] == 2 * 5000 + 3 * 4096 + 90 and p.where("doc_id = 8").count() == 3
    assert p.where("container_id is null").count() == 2 and packing.certificate(p).first().bound <= bins.count()


def test_what_is_not_certified_is_marked(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(i, r.choice([34, 35, 51, 52, 67])) for i in range(900)], "doc_id long, n_tokens int")
    p = packing.pack(df, capacity=100, per_partition=100, rounds=1).cache()
    assert p.where("certified is null").count() == 0
    by_part = p.select("container_id", "certified").distinct().groupBy("certified").count().collect()
    c = packing.certificate(p, 100).first()
    assert {x.certified: x["count"] for x in by_part}.get(True, 0) == c.certified <= c.containers and c.bound <= c.containers


def test_nothing_to_pack(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens int")).count() == 0
