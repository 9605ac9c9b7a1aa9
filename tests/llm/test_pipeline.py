"""The pipeline's stages against brute force, each on what its predecessor kept, and run() as their composition."""

import hashlib
import math
import random
import re

import corpus_pipeline
from tests.llm import rows
from tests.llm.test_mixing import plain_mix
from tests.llm.test_quality import plain_kept
from vectrail.llm import mixing, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    """Documents with junk, near copies (one word of forty changed), benchmark passages, personal data, nulls, ties and repeats."""
    r = random.Random(11)
    say = lambda n: " ".join(f"w{r.randint(0, 9000)}" for _ in range(n))
    texts = [say(r.randint(20, 160)) for _ in range(60)]
    for i in range(0, 12):
        words = texts[i].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    item = say(14)
    texts += [f"{say(20)} {item} {say(9)}", f"{say(20)} {' '.join(item.split()[2:13]).upper()} {say(5)}"]
    texts += [f"{say(15)} write to someone{i}@mail.example.com or call +1 415 555 01{i:02d} now {say(9)}" for i in range(10)]
    texts += ["too short", "", None, "same five words again " * 12, texts[0], texts[3]]
    out = [(i, t, ("en", "de", None)[i % 3], ("web", "code", None, "wiki")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    return [*out, (None, say(30), "en", "web", 1), (None, say(31), "en", "web", 1), out[5], (len(out), None, None, None, None)], item


def five(text):
    w = [x.lower() for x in rows.words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_dedup(docs):
    """One row a group: links at Jaccard 0.8 of five-word shingles, copies and blank texts are one."""
    sets, group = [five(d[1]) for d in docs], list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {}
    for g, d in zip(group, docs, strict=True):
        ids.setdefault(g, []).append(d)
    return [min(x, key=lambda d: (d[0] is None, d[0] or 0)) for x in ids.values()]


def windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} if w else set()


def plain_clean(docs, item):
    return [d for d in docs if not windows(item)[1] & windows(d[1])[1]]


def show(found):
    return sorted(map(tuple, found), key=repr)


def test_stages(spark, tmp_path):
    data, item = corpus()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    where = rows.stored(docs.repartition(3), tmp_path)
    rows.stored(spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"), tmp_path, "benchmark")
    rows.stored(spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    step = {name: (lambda d, f=f: spark.createDataFrame(f(spark, d, where).collect(), f(spark, d, where).schema)) for name, f in corpus_pipeline.STAGES}

    kept = step["quality_rules"](docs)
    good, _ = plain_kept([(i, d[1], d[2]) for i, d in enumerate(data)], {}, {}, 0.01, 0.05)
    assert show(kept.collect()) == show(d for i, d in enumerate(data) if good[i]) and kept.columns == COLUMNS

    one = step["near_dedup"](kept)
    want = plain_dedup([tuple(r) for r in kept.collect()])
    assert show(one.collect()) == show(want) and one.columns == COLUMNS

    clean = step["decontamination"](one)
    assert show(clean.collect()) == show(plain_clean([tuple(r) for r in one.collect()], item)) and clean.count() == one.count() - 2

    safe = step["pii_redaction"](clean)
    spans = {(r["doc_id"], r["text"]): r["s"] for r in clean.select("doc_id", "text", pii.accepted(pii.candidates(clean["text"]), pii.fit(clean.select(pii.candidates(clean["text"]).alias("spans")))).alias("s")).collect()}

    def redacted(i, text):
        out, at = "", 0
        for s in sorted(spans[i, text], key=lambda s: (s["start"], s["end"], s["kind"])):
            if s["start"] >= at:
                out += text[at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        return out + text[at:]

    assert show(safe.collect()) == show((r[0], redacted(r[0], r[1]), *r[2:]) for r in clean.collect())
    assert not any("@" in r["text"] for r in safe.collect()) and any("[EMAIL]" in r["text"] for r in safe.collect())

    mixed = corpus_pipeline.STAGES[-1][1](spark, safe, where)
    sizes = safe.select("doc_id", "source", mixing.words().alias("size"))
    t = {r["source"]: (r["target"], r["queue"]) for r in mixing.targets(sizes).where("target > 0").collect()}
    listed = [tuple(r) for r in sizes.where("doc_id IS NOT NULL").collect()]
    if len(listed) == sizes.count():
        plain = plain_mix(listed, t, math.floor(1.5 * sum(x[2] for x in listed)), mixing.PACKET)
        assert sorted((r["doc_id"], r["taken"]) for r in mixed.collect()) == sorted((i, taken) for i, _, taken in plain if taken)
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in safe.collect()}

    whole = corpus_pipeline.run(spark, where)
    digest = lambda d: sorted(hashlib.sha256(repr((r["doc_id"], r["text"], r["taken"])).encode()).hexdigest() for r in d.collect())
    assert digest(whole) == digest(mixed)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    docs = rows.frame(spark)
    rows.stored(spark.createDataFrame([(1, "w1")], "item_id long, text string"), tmp_path, "benchmark")
    where = rows.stored(spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, where).columns == docs.columns
        assert stage(spark, rows.frame(spark, []), where).count() == 0
