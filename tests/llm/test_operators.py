"""The corpus operators against brute force on small tables full of nulls, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import re
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from billgrain.llm import fertility, licenses, linededup, mixing, neighbours, packing, queries, sharding, simhash, toxicity, warc
from billgrain.session import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, body long, score string, epoch int, digest string, length int"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with names that operators use."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7)))
    line = lambda n=12: " ".join(word() for _ in range(n)) + "."
    shared = [line() for _ in range(8)]
    texts = ["\n".join([line() for _ in range(rng.randint(1, 6))] + rng.sample(shared, 2)) for _ in range(60)]
    texts += [texts[0]] * 30 + [t.replace("a", "b", 1) for t in texts[:8]]
    texts += ["\n".join(f"item number {k:04d} of the long list of things" for k in range(40))]
    texts += [None, "", " \n\t", "x", "don't 's <|endoftext|> <|ENDOFTEXT|> A.B., É!   ok", " ".join(line(200) for _ in range(40)), "Released under the MIT licence!\nbody"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src1", "src7", None]), None, 1, 2, "s", 3, "d", 4) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", None, None, None, 1, 2, "s", 3, "d", 4), (None, None, None, None, None, 1, 2, "s", 3, "d", 4)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def words(text):
    return (text or "").encode().split()


def test_shards_are_contiguous_and_even(spark, docs):
    rows = sharding.byte_shards(docs, shards=4).collect()
    source = docs.collect()
    assert sorted((r.doc_id is None, r.doc_id, r["size"], r.text_crc32) for r in rows if r.doc_id is not None) == sorted(
        (False, s.doc_id, len((s.text or "").encode()) + 1, zlib.crc32((s.text or "").encode())) for s in source if s.doc_id is not None
    )
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    sizes = [sum(r["size"] for r in rows if r.shard == k) for k in range(4)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    assert sharding.byte_shards(docs.limit(0)).count() == 0


def test_mix_deals_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "3", 100), ("b", "x", "4", 1000)], "domain string, language string, origin string, available long")
    got = {r.origin: r.budget for r in mixing.leaf_budgets(leaves, {"domain": {"a": 1, "b": 1}}, F.lit(200), 1).collect()}
    # a and b get 100 each, x and y of a 50 each; leaf 1 holds 10 of its 25, leaf 2 takes the rest
    assert got == {"1": 10, "2": 40, "3": 50, "4": 100}
    got = {r.origin: r.budget for r in mixing.leaf_budgets(leaves, {"domain": {"a": 9, "b": 1}}, F.lit(500), 1).collect()}
    assert got == {"1": 10, "2": 100, "3": 100, "4": 290}  # what all of a lacks goes to b


def test_mix_takes_prefixes_of_seeded_epochs(spark, docs):
    got = queries.mix(docs).select("doc_id", "text", "domain", "language", "origin", mixing.n_words(mixing.text_of()).alias("tokens"), "epoch").collect()
    rows = docs.withColumn("domain", queries.domain()).collect()
    total = sum(len(words(r.text)) for r in rows)
    taken = sum(r.tokens for r in got)
    assert 0.3 * total <= taken <= 0.5 * total + 1
    assert max(r.epoch for r in got) <= 1
    assert queries.mix(docs.limit(0)).count() == 0


def test_bit_parallel_edit_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(1500):
        a = [rng.choice("abé") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at, act = rng.randint(0, len(b)), rng.random()
            if act < 0.4 or not b:
                b.insert(at, rng.choice("abé"))
            elif act < 0.7:
                b[at - 1] = rng.choice("abé")
            else:
                del b[at - 1]
        rows.append(("".join(a), "".join(b)))
    pairs = spark.createDataFrame(rows, "a string, b string")
    for most in (1, 2):
        assert pairs.where(f"least({linededup.edit_distance('a', 'b', most)}, {most + 1}) != least(levenshtein(a, b), {most + 1})").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_line_classes(spark, docs, most):
    lines, near = {}, {}
    for r in docs.collect():
        body = xxhash.xxh64_intdigest((r.text or "").encode(), 42)
        body -= (body >> 63) << 64
        for no, line in enumerate((r.text or "").split("\n")):
            line = line.strip(" \t\r")
            if len(line) >= 20:
                lines.setdefault(line, []).append(((r.doc_id is not None, r.doc_id or 0), body, no))
    for a in lines:
        for b in lines:
            if a < b and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                near.setdefault(a, []).append(b)
                near.setdefault(b, []).append(a)
    assert sum(map(len, near.values())) > 300  # the numbered items meet in one crowd
    expected = []
    for line, places in lines.items():
        first = min(places)
        late = any(min(lines[o]) < first for o in near.get(line, []))
        expected += [(p, len(places), len(near.get(line, [])), p == first and not late) for p in places]
    got = linededup.line_classes(docs, max_edits=most).collect()
    assert sorted((((r.doc_id is not None, r.doc_id or 0), r.body, r.line_no), r.times, r.links, r.kept) for r in got) == sorted(expected)


def test_documents_without_repeated_lines(spark, docs):
    got = linededup.without_repeated_lines(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    by_id = {r.doc_id: r.text for r in got.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert by_id[0] == texts[0] and by_id[61] == ""  # a copy loses all lines
    assert [k for k, t in texts.items() if t is None and k is not None] == [k for k, t in by_id.items() if t is None and k is not None]
    assert linededup.without_repeated_lines(docs.limit(0)).count() == 0


def test_short_lines_repeat_exactly(spark):
    texts = ["Home\na line of more than twenty characters\n\nNext", "Home \nHone\n\nA", "A\na line of more than twenty charakters\n\tHome", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in linededup.without_repeated_lines(docs, short=True).collect()}
    assert got == {0: texts[0], 1: "Hone\n\nA", 2: "", 3: None, 4: ""}
    rows = {(r.doc_id, r.line_no): (r.first_id, r.first_line, r.times, r.links, r.kept) for r in linededup.line_classes(docs, short=True).collect()}
    assert rows[(2, 2)] == (0, 0, 3, 0, False) and rows[(1, 1)] == (1, 1, 1, 0, True) and len(rows) == 9
    assert linededup.line_classes(docs).count() == 2


def brute_fingerprint(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if x]
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(spark, docs):
    rows = docs.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    least = [r.doc_id for r in rows]
    for _ in rows:
        new = [min((least[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 3 and least[j] is not None), default=None) for i in range(len(rows))]
        if new == least:
            break
        least = new
    got = simhash.near_duplicates(docs).collect()
    key = lambda i, p, c: (i is not None, i or 0, p, c is not None, c or 0)
    assert sorted(key(r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got) == sorted(key(r.doc_id, p, c) for r, p, c in zip(rows, prints, least))
    one = simhash.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in one if r.doc_id is not None) == sorted({c for c in least if c is not None})
    assert [r.text for r in one if r.doc_id is None] == ["no id"]  # a component without any id
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_across_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.int64)
    codes = np.unique(np.r_[base, *[base ^ (1 << int(b)) for b in rng.integers(0, 40, 30)]])
    monkeypatch.setattr(simhash, "CHUNK", 7)
    edges = simhash.near_edges(spark.createDataFrame([(int(c),) for c in codes], "fingerprint long"))
    unsigned = codes.view(np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(unsigned[:, None] ^ unsigned[None]) <= 3, 1))
    at = {int(c): k for k, c in enumerate(codes)}
    got = [(at[r.u], at[r.v]) for r in edges.collect()]
    left, right = (np.array([p[k] for p in got], int) for k in (0, 1))
    assert (simhash.stars(len(codes), i, j) == simhash.stars(len(codes), left, right)).all()


def test_licenses(docs):
    got = {(r.doc_id, r.license, r.scope): r.times for r in licenses.licenses(docs).collect()}
    assert [(k[1:], v) for k, v in got.items()] == [(("MIT", "line"), 1)]
    assert licenses.licenses(docs.limit(0)).count() == 0


def test_whole_licence_texts(spark):
    text = dict(licenses.whole_texts())
    mit, gpl = text["MIT"], text["GPL-3.0"]
    header = (licenses.Path(licenses.__file__).parent / "license_texts" / "Apache-2.0.header.txt").read_text()
    rows = [
        (0, "Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sublicence").replace("COPYRIGHT HOLDERS", "Copyright Holders")),
        (1, "Notes\n\n" + mit.replace("\n\n", "\0").replace("\n", " ").replace("\0", "\n \n") + "\n\nmore text"),
        (2, gpl),
        (3, "import x\n\n" + header + "\nrest"),
        (4, "first\n\nThis project is licensed\nunder the terms of the MIT license.\n\nlast"),
        (5, mit.split("\n\n")[0]),
        (6, text["BSD-3-Clause"] + "\n" + text["BSD-3-Clause"]),
    ]
    got = {(r.doc_id, r.license, r.scope): r.times for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = {(0, "MIT", "document"): 1, (0, "MIT", "block"): 1, (1, "MIT", "block"): 1, (2, "GPL-3.0", "document"): 1, (2, "GPL-3.0", "block"): 1}
    expected |= {(3, "Apache-2.0", "line"): 1, (3, "Apache-2.0", "block"): 1, (4, "MIT", "block"): 1, (6, "BSD-3-Clause", "block"): 2}
    assert got == expected


def test_licence_texts_at_all_widths(spark):
    import textwrap

    rows, names = [], []
    for name, text in licenses.whole_texts():
        blocks = [" ".join(b.split()) for b in re.split(r"\n\s*\n", text) if b.strip()]
        for width in (40, 53, 60, 72, 80, 99, 120, 10**6):
            rows.append((len(rows), "\n\n".join(textwrap.fill(b, width, break_long_words=False) for b in blocks)))
            names.append(name)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {(r.doc_id, r.license) for r in licenses.licenses(table).collect() if r["scope"] == "document"}
    assert {(i, name) for i, name in enumerate(names)} <= got
    bsd = dict(licenses.whole_texts())["BSD-3-Clause"]
    changed = spark.createDataFrame([(0, bsd.replace("\n\n", "\n\ncopyright license to sell is not given\n\n", 2)), (1, bsd), (1, bsd)], "doc_id long, text string")
    found = {(r.doc_id, r["scope"]): r.times for r in licenses.licenses(changed).collect()}
    assert found == {(1, "document"): 2, (1, "block"): 2}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokeniser = Tokenizer.from_file(path)
    expected = []
    for r in docs.collect():
        ids = [*tokeniser.encode(r.text or "", add_special_tokens=False).ids, 0]
        expected += [(r.doc_id is not None, r.doc_id or 0, k // 256, k, len(p := ids[k : k + 256]), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(0, len(ids), 256)]
    got = packing.packed_documents(docs, path, capacity=256).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    # no two pieces above half a sequence can share one
    least = max(-(-sum(e[4] for e in expected) // 256), sum(e[4] > 128 for e in expected))
    assert max(ends.values()) <= 256 and len(ends) <= 1.05 * least
    assert packing.packed_documents(docs.limit(0), path).count() == 0
    clash = spark.createDataFrame([(i, 0, 1 + i % 9, 1, 2, 3, 4, 5) for i in range(50)], "id long, piece int, length long, first int, last int, each int, bin0 int, offset0 int")
    assert packing.packed(clash, 16).count() == 50
    whole = packing.sequences(docs, path, 256)
    assert whole.where("octet_length(ids) != 4 * n_ids").count() == 0 and whole.count() == len(ends)


def test_fullest_combination():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(4)}
        room, sums = rng.randint(0, 40), {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        chosen = packing.fullest(counts, room)
        assert sum(chosen) == max(s for s in sums if s <= room) and all(chosen.count(x) <= counts[x] for x in chosen)


def test_fertility_counts(docs):
    got = {r.doc_id: r for r in fertility.fertility_verdicts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect() if r.doc_id is not None}
    for r in docs.where("doc_id is not null").collect():
        text, w, g = r.text or "", words(r.text), got[r.doc_id]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(w) < 2000 else None
        lines = [x for x in text.split("\n") if words(x)]
        assert (g.n_words, g.word_chars, g.n_symbols) == (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"))
        assert g.n_dup_lines == len(lines) - len(set(lines))
        if inside is not None:
            assert g.n_repeat_words == len(inside)
            assert g.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (g.base_failed and g.kept)
    assert fertility.fertility_verdicts(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def brute_verdicts(rows, path):
    """``id -> (tokens, byte tokens, kept)`` of texts that pass the base rules, by plain loops."""
    from sentencepiece import SentencePieceProcessor

    pieces, measured = SentencePieceProcessor(model_file=path), {}
    for i, text, lang, script in rows:
        ids = [t for w in text.split() for t in pieces.encode(w)]
        entropy = -sum(ids.count(t) / len(ids) * np.log2(ids.count(t) / len(ids)) for t in set(ids))
        fallen = sum(pieces.is_byte(t) or pieces.is_unknown(t) for t in ids)
        chars = sum(map(len, text.split()))
        measured[i] = (lang or script, script, len(ids), fallen, (chars / len(ids), fallen / len(ids), entropy / np.log2(len(ids))))
    middles = {b: np.median(np.round([m[4] for m in measured.values() if m[0] == b], 4), axis=0) for b in {m[0] for m in measured.values()}}
    off = {i: (np.array(m[4]) - middles[m[0]]) * [m[2] ** 0.5, 1, 1] for i, m in measured.items()}
    quartiles = lambda k, name: np.percentile([[round(o[0], 2), round(o[1], 4), round(o[2], 4)] for i, o in off.items() if measured[i][k] == name], [25, 75], axis=0)
    found = {}
    for i, (band, script, n_tokens, fallen, _) in measured.items():
        n = sum(m[0] == band for m in measured.values())
        low, high = (n * quartiles(0, band) + 100 * quartiles(1, script)) / (n + 100)
        wide = high - low
        more = 1 / n**0.5
        inside = low[0] - wide[0] * (2.5 + more) <= off[i][0] <= high[0] + wide[0] * (2.5 + more)
        inside = inside and off[i][1] <= high[1] + wide[1] * (2.5 + more) + 0.1 and off[i][2] >= low[2] - wide[2] * (3 + more)
        found[i] = (n_tokens, fallen, bool(inside))
    return found


def test_fertility_verdicts(spark):
    rng = random.Random(9)
    draw = lambda letters, n=90: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, n)))
    rows = [(i, draw("etaoinshrdlu"), "en", "latin") for i in range(150)]
    for lang, n in (("ru", 99), ("uk", 20), ("bg", 1), (None, 100)):
        rows += [(len(rows) + k, draw("оеаинтсрвл") + (" Latin" if k % 2 else ""), lang, "cyrillic") for k in range(n)]
    clean = len(rows)
    rows += [(clean, draw("\U0001f600\U0001f680x"), "en", "latin"), (clean + 1, draw("qxzjw#$%"), "en", "latin"), (clean + 2, "same the " * 20 + draw("a"), "en", "latin")]
    table = spark.createDataFrame([(i, t, lang, 1) for i, t, lang, _ in rows], "doc_id long, text string, lang string, script int").repartition(7)
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in fertility.fertility_verdicts(table, path).collect()}
    passing = [r for r in rows if not got[r[0]].base_failed]
    assert len(passing) >= clean
    assert {i: (got[i].n_tokens, got[i].n_byte_tokens, got[i].kept) for i, *_ in passing} == brute_verdicts(passing, path)
    assert not got[clean].kept and sum(got[i].kept for i in range(clean)) >= clean - 3
    assert all(got[i].kept for i in range(150, clean) if rows[i][2] == "bg")
    assert fertility.script_of("a é ж и я") == "cyrillic" and fertility.script_of("1 2 ,") == "none"


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    moves, sizes = rng.normal(size=(2, 2)), [1, 4, 2, 4]
    lift = rng.normal(size=sum(sizes))
    got, at = toxicity.marginals(lift, np.cumsum(sizes) - sizes, moves), 0
    for n in sizes:
        mass = np.zeros((n, 2))
        for path in range(1 << n):
            states = [path >> k & 1 for k in range(n)]
            weight = np.exp(sum(lift[at + k] * s for k, s in enumerate(states)) + sum(moves[a, b] for a, b in zip(states, states[1:])))
            for k, s in enumerate(states):
                mass[k, s] += weight
        assert np.allclose(np.log(mass[:, 1] / mass[:, 0]), got[at : at + n])
        at += n


def test_toxic_spans_on_held_out_texts(spark):
    rng = random.Random(4)
    clean = lambda: [rng.choice(["tree", "house", "river", "stone", "green", "walks", "over", "light"]) for _ in range(60)]
    rows = []
    for i in range(400):
        w = clean()
        if i % 4 == 0:
            for k in rng.sample(range(60), 3):
                w[k] = rng.choice(["grubling", "grubbed,", "Grubs!", "vexnard"])
        rows.append((i, " ".join(w), int(i % 4 == 0), "x"))
    rows += [(400, None, None, "x"), (401, "", 0, "x"), (None, "grubling", 1, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    model = toxicity.fitted(table.select("doc_id", "text"), table.where("doc_id < 300 or doc_id is null").select("doc_id", "toxic"))
    got = toxicity.toxic_spans(table, model).collect()
    held = [r for r in got if r.doc_id is not None and 300 <= r.doc_id < 400]
    assert all((r.score >= 0.7) == bool(r.toxic) for r in held)
    for r in held:
        for s in r.spans:
            assert all(re.match("grub|vexnard", x.lower()) for x in r.text[s.start : s.end].split())
    assert all(r.score < 0.5 for r in got if not r.text)
    nothing = toxicity.fitted(table.select("doc_id", "text").limit(0), table.select("doc_id", "toxic").limit(0))
    assert all(r.score < 0.01 for r in toxicity.toxic_spans(table, nothing).collect())


def test_loser_tree():
    rng = random.Random(7)
    for k in (1, 2, 3, 7, 8):
        runs = [sorted(({"key": rng.choice("abc"), "time": str(rng.randint(0, 5)), "id": str(rng.randint(0, 50))} for _ in range(rng.randint(0, 6))), key=warc.order) for _ in range(k)]
        assert [warc.order(x) for x in warc.merged(runs)] == sorted(warc.order(x) for r in runs for x in r)


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_RECORDS", 10)
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    rng = random.Random(8)
    long = ["é" * 700, "a\r\n\r\nWARC/1.1\r\n" * 90]
    rows = [(i, f"http://www.h{i % 3}.org/p?b={i % 5}&a=1", rng.choice([*long, f"own {i} " * 200, "short", "", None]), "x") for i in range(90)]
    rows += [(90 + i, "http://one.org/", long[0], "x") for i in range(60)] + [rows[1], (None, None, long[0], "x"), (None, "bad url\n[", "alone" * 300, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(4).cache()
    got = warc.archived(pages, f"{shared_dir(spark)}/{uuid.uuid4().hex}").collect()
    largest = {}
    for i, _, html, _ in rows:
        if html and len(html.encode()) >= 1000 and i is not None:
            largest[html] = max(largest.get(html, i), i)
    expected = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        keeper = largest.get(html) if len(data) >= 1000 else None
        revisit = keeper is not None and keeper != i
        expected.append(repr((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None)))
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(expected)
    ordered = sorted(got, key=lambda r: r.position)
    assert [r.position for r in ordered] == list(range(len(rows)))
    assert all((a.url_key, a.captured) <= (b.url_key, b.captured) for a, b in zip(ordered, ordered[1:]))
    assert warc.archived(pages.limit(0), f"{shared_dir(spark)}/{uuid.uuid4().hex}").count() == 0


def test_nearest_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:140] = x[0]  # copies of a query
    rows = [(int(i) * 10, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(7001, None, "x"), (7100, [0.0] * 16, "x"), (7200, [float("nan")] * 16, "x"), (7300, [1.0, None, *[0.0] * 14], "x"), rows[5], (None, x[1].tolist(), "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, distance string")
    got = {}
    for r in neighbours.nearest_rows(table, every=500, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 7000, 500):
        d = np.sqrt(((x.astype(float) - x[q // 10].astype(float)) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((np.arange(700), d)) if k * 10 != q][:10]
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 11))
        assert all(abs(d[i // 10] - s) < 1e-12 for _, i, s in got[q])
        hits += len({i for _, i, _ in got[q]} & {k * 10 for k in order})
    assert hits >= 0.95 * 140 and [i for _, i, _ in sorted(got[0])] == list(range(1000, 1100, 10))
    assert set(got) == set(range(0, 7000, 500))
    assert neighbours.nearest_rows(table.limit(0)).count() == 0
    few = neighbours.nearest_rows(table.where("vec_id in (0, 10, 20)"), every=500).collect()
    mixed = table.where("vec_id in (0, 10, 20)").unionByName(spark.createDataFrame([(30, [1.0, 2.0], "x")], table.schema))
    mixed = neighbours.nearest_rows(mixed.withColumn("vec_id", F.col("vec_id").cast("int")), every=500).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in mixed] == [(r.query_id, r["rank"], r.vec_id, r.score) for r in few]
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] in ([10, 20], [20, 10])
