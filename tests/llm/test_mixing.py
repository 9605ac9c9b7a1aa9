"""The mix against a plain simulation of fair queues."""

import hashlib
import heapq
import math

from tests.llm import rows
from vectrail.llm import mixing

PACKET = 16


def plain_mix(docs, targets, budget, packet=PACKET):
    """(doc_id, size, taken) by serving packets in order of virtual finish time."""
    queues = {}
    for d in sorted(docs, key=lambda d: (hashlib.md5(str("" if d[0] is None else d[0]).encode()).hexdigest(), d[0] is not None, d[0] or 0, d[2])):
        queues.setdefault(d[1], []).append(d)
    heap, taken = [], {}
    for source, own in queues.items():
        place = 0
        for _ in range(2):
            for i, d in enumerate(own):
                for k in range(0, d[2], packet):
                    words = min(packet, d[2] - k)
                    place += words
                    heapq.heappush(heap, (place / targets[source][0], targets[source][1], place, words, source, i))
    while heap and budget > 0:
        _, _, _, words, source, i = heapq.heappop(heap)
        taken[source, i] = taken.get((source, i), 0) + min(words, budget)
        budget -= words
    return sorted(((d[0], d[2], taken.get((s, i), 0)) for s, own in queues.items() for i, d in enumerate(own)), key=repr)


def sizes(spark):
    return rows.frame(spark).select("doc_id", "source", mixing.words().alias("size"))


def test_schedule_is_fair_queueing(spark):
    d = sizes(spark)
    t = {r["source"]: (r["target"], r["queue"]) for r in mixing.targets(d).where("target > 0").collect()}
    docs = [tuple(r) for r in d.collect()]
    budget = math.floor(1.5 * sum(x[2] for x in docs))
    out = mixing.schedule(d, packet=PACKET)
    got = out.collect()
    assert sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=repr) == plain_mix(docs, t, budget)
    assert sum(r["taken"] for r in got) == budget
    for source, (target, _) in t.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == source) - target) <= PACKET
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_the_cut_decides(spark, monkeypatch):
    """Another place of the cut gives another mix: nothing but the global order decides."""
    d, whole = sizes(spark), rows.found(mixing.schedule(sizes(spark)), "doc_id", "size", "taken")
    real = mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda placed, budget, *a: real(placed, budget // 2, *a))
    half = mixing.schedule(d).collect()
    assert rows.found(mixing.schedule(d), "doc_id", "size", "taken") != whole
    assert sum(r["taken"] for r in half) == math.floor(1.5 * sum(r["size"] for r in half)) // 2
    monkeypatch.setattr(mixing, "cut", lambda *a: (-1.0, 0, 0, 0))
    assert not any(r["taken"] for r in mixing.schedule(d).collect())


def test_buckets_do_not_matter(spark, monkeypatch):
    """Many small buckets and ranges give the same mix; reruns agree."""
    one = rows.found(mixing.schedule(sizes(spark)), "doc_id", "size", "taken")
    monkeypatch.setattr(mixing, "ROWS", 1)
    assert rows.found(mixing.schedule(sizes(spark)), "doc_id", "size", "taken") == one


def test_mix_keeps_columns_and_null_sources(spark):
    docs = rows.frame(spark)
    out = mixing.mix(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and "_taken" in out.columns
    assert any(r["source"] is None for r in out.collect())
    assert mixing.mix(rows.frame(spark, [])).count() == 0
