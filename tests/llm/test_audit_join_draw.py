"""Filter audit, Jaccard join and resampling against brute force, on odd and hostile tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest

from billgrain.llm import filteraudit, jaccard, resampling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, id string, s string, n string, part string, row string, line string"
CLASHING = ("x",) * 6


def prose(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus(rng):
    base = [prose(rng, rng.randrange(1, 140), 400) for _ in range(25)]
    texts = list(base)
    for text in base:  # near and exact copies
        words = text.split()
        for _ in range(rng.randrange(4)):
            changed = list(words)
            for _ in range(rng.randrange(3)):
                changed[rng.randrange(len(changed))] = f"n{rng.randrange(1000)}"
            texts.append(" ".join(changed))
    texts += [base[0]] * 30 + [base[0] + f" end{i}" for i in range(30)]
    texts += [None, None, "", "", " \n\t ", "one", "ONE", "one two", "Ünïcode ÄÖ $", "A B C D", "a#b", "long " * 3000, "Line\nline\n\nLINE", "x y\nz"]
    rows = [(i, t, rng.choice(["en", "de", None, ""]), *CLASHING) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[1], "en", *CLASHING), (None, base[1], "en", *CLASHING), (None, None, None, *CLASHING), (3, "other words here", "de", *CLASHING)]
    rng.shuffle(rows)
    return rows


# ---- filter audit


def audited(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    docs = []
    for i, t, part, *_ in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        docs.append((part or "", {f for f in fails if fails[f]}, i is not None and i in good, i is not None and i in toxic))
    out = set()
    for part in {d[0] for d in docs}:
        mine, shapley, found = [d for d in docs if d[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            for step in range(1, 6):
                own, early = order[step - 1], set(order[: step - 1])
                here = [d for d in mine if own in d[1] and not d[1] & early]
                shapley[own] += len(here)
                found.append((
                    "".join(order), step, sum(not d[1] & (early | {own}) for d in mine), len(here), sum(own in d[1] and bool(d[1] & early) for d in mine),
                    sum(d[1] == {own} for d in mine), sum(d[2] for d in here), sum(d[3] for d in here), own,
                ))
        out |= {(part, *f[:-1], shapley[f[-1]]) for f in found}
    return out


@pytest.mark.parametrize("shard_bytes", [1, 8 << 20])
def test_filter_audit(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(filteraudit, "SHARD_BYTES", shard_bytes)
    rows = corpus(random.Random(1))
    rows[0] = (rows[0][0], " ".join(f"v{i}" for i in range(200)) + " $", *rows[0][2:])
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (99999, 1, 1)]
    found = filteraudit.filter_interactions(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in found.collect()} == audited(rows, labels)


def test_matrix_has_dense_numbers_and_all_counts(spark):
    rows = corpus(random.Random(2))
    csr, known = filteraudit.document_term_matrix(spark.createDataFrame(rows, DOCS).repartition(4))
    words = {r.number: bytes(r.word).decode() for r in known.collect()}
    assert sorted(words) == list(range(len(words)))
    found = []
    for shard in csr.collect():
        for i, doc in enumerate(shard.id):
            a, b = shard.indptr[i], shard.indptr[i + 1]
            found.append((doc, tuple(sorted((words[k], n) for k, n in zip(shard.indices[a:b], shard.data[a:b])))))
    wanted = [(r[0], tuple(sorted(Counter(WORD.findall(r[1] or "")).items()))) for r in rows]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_audit_of_an_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert filteraudit.filter_interactions(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# ---- Jaccard join


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def joined(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("chunk, hot_part, seed", [(2048, 50, 3), (4, 50, 4), (4, 10**9, 5)])
def test_jaccard_components(spark, monkeypatch, chunk, hot_part, seed):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "HOT_PART", hot_part)
    rows = corpus(random.Random(seed))
    found = jaccard.near_sets(spark.createDataFrame(rows, DOCS).repartition(5))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == joined(rows)


def test_second_round_finds_links_between_components(spark):
    """A ring of texts, each alike only to its neighbours: stars of one round cannot close it."""
    rng = random.Random(6)
    words = [f"r{i}" for i in range(400)]
    texts = [" ".join(words[i * 6 : i * 6 + 100]) for i in range(50)]
    rows = [(i, t, "en", *CLASHING) for i, t in enumerate(texts)]
    rows += [(100 + i, prose(rng, 60, 30) + " " + " ".join(words[:30]), "en", *CLASHING) for i in range(20)]
    found = jaccard.near_sets(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == joined(rows)


def test_signatures_bound_the_overlap_from_above():
    rng = random.Random(7)
    for _ in range(300):
        a = prose(rng, rng.randrange(1, 300), 20).encode()
        b = prose(rng, rng.randrange(1, 300), 20).encode()
        x, y = jaccard.shingle_sets([a, b], 2)
        import numpy as np

        p, q = (np.frombuffer(jaccard.signature(v), "<u8") for v in (x, y))
        width = min(len(p), len(q))
        p, q = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (p, q))
        bound = (len(x) + len(y) - int(np.bitwise_count(p ^ q).sum())) // 2
        assert bound >= len(np.intersect1d(x, y))


def test_jaccard_of_an_empty_table(spark):
    assert jaccard.near_sets(spark.createDataFrame([], DOCS)).collect() == []


# ---- resampling


def weighed(rows, target, longest, buckets, percent, least):
    def parts(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    docs = [(r[0], *parts(r[1])) for r in rows]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for text in target for b in parts(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    scored = []
    for i, n_words, features in docs:
        weight = sum(gain[b] for b in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n_words, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    drawn = [(x[0], *x[2:], k + 1 if k < percent * len(able) // 100 else None) for k, x in enumerate(able)]
    return sorted([*drawn, *((x[0], *x[2:], None) for x in scored if x[1] < least)], key=repr)


@pytest.mark.parametrize("longest, percent, least", [(1, 10, 20), (1, 100, 0), (2, 30, 5), (3, 50, 1)])
def test_resampling(spark, longest, percent, least):
    rows = corpus(random.Random(8))
    target = ["w1 w2\nw3 W4", None, "", "one two-three Ünï"]
    found = resampling.resampled(
        spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), longest, 500, "2024", percent, least
    )
    assert sorted((tuple(r) for r in found.collect()), key=repr) == weighed(rows, target, longest, 500, percent, least)


def test_resampling_of_empty_tables(spark):
    docs, none = spark.createDataFrame(corpus(random.Random(9)), DOCS), spark.createDataFrame([], DOCS)
    assert resampling.resampled(none, docs).count() == 0
    assert resampling.resampled(docs, none, least_words=1).where("rank = 1").count() == 1
