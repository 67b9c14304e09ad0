"""Personal data, licenses, benchmark items and repeated passages."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracewell.llm import decontamination, licenses, pii, substrings
from tracewell.llm.queries import op4_licenses, op7_decontamination, op8_substrings, op10_pii
from tracewell.llm.words import plain_words

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and plain_luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out


@given(st.text(alphabet="a.@-1 2+(9)%é", max_size=80))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_query_against_brute_force(spark, small):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op10_pii(spark, small).collect():
        base = plain_spans(docs[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert set(line.split(",")) - {""} <= set(r["spans"].split(","))


def test_added_spans(spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r["text"]]
    judge = pii.Judge(texts)
    found = lambda t: {(k, t[a:b]) for k, a, b in judge.added(t, pii.base_spans(t), True)}
    assert ("email_obscured", "alice at mail7 dot example dot com") in found("please write mail: alice at mail7 dot example dot com today")
    assert any(k == "secret" for k, _ in found('here token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" with'))
    assert not found("He stood at the door dot. See page 12 345 67 and /usr/local/share/v2 for 2024 notes")
    assert pii.redacted("a x@y.zz b", [("email", 2, 8)]) == "a [EMAIL] b"


def test_scans_of_long_texts_end():
    text = "a" * 300_000 + "1" * 300_000 + " at " * 1000
    assert pii.base_spans(text) == [] and isinstance(pii.candidates(text), list)


def test_license_query(spark, small):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {(r["doc_id"], docs[r["doc_id"]][r["start"] : r["end"]]) for r in op4_licenses(spark, small).collect()}
    want = {(i, t.rstrip(".")) for i, text in docs.items() for t in licenses.TEMPLATES.values() if t in text}
    assert got == want


def test_edited_and_shifted_licenses():
    index = licenses.Index(licenses.TEMPLATES)
    body = licenses.TEMPLATES["MIT/text"]
    words = ("é intro words " + body + " and after").split()
    words[20:20] = ["extra", "words"]
    del words[40]
    words[60] = "changed"
    (name, share, a, b), = licenses.scan(index, " ".join(words).encode(), 0.8)
    assert name == "MIT/text" and 0.95 < share < 1 and a == 3 and b > 80
    assert licenses.scan(index, b"permission to use the software and the license", 0.8) == []
    twice = licenses.scan(index, b"Released under the MIT License. x y Released under the MIT License.", 0.8)
    assert [m[2:] for m in twice] == [(0, 5), (7, 12)]
    assert licenses.Index({}).seeds(np.array([1, 2, 3, 4])) == {}


@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), max_size=30))
def test_edit_match_against_dynamic_programming(pattern, text):
    row = list(range(len(pattern) + 1))
    best = None
    for j, w in enumerate(text):
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != w), row[i + 1] + 1, new[i] + 1))
        row = new
        if best is None or row[-1] < best[0]:
            best = row[-1], j + 1
    got = decontamination.edit_match(pattern, text, len(pattern))
    assert got == (best if best and best[0] <= len(pattern) else None)


def test_benchmark_items_with_edits():
    rng = random.Random(3)
    vocabulary = [f"v{k}".encode() for k in range(400)]
    items = [(i, b" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(15, 50)))) for i in range(60)]
    index = decontamination.Index(items, 0.2, 0.95, 5)
    docs, truth = [], []
    for k in range(200):
        item, words = rng.choice(items)
        words = words.split()
        for _ in range(int(0.2 * len(words))):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 1)] = [b"new"] if kind < 2 else []
        around = [rng.choice(vocabulary) for _ in range(60)]
        docs.append(b" ".join(around[:30] + words + around[30:]))
        truth.append((k, item))
    got = {(d, index.items[i][0]) for d, i, *_ in decontamination.matches(index, docs)}
    assert sum(t in got for t in truth) >= 0.92 * len(truth)
    clean = [b" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(100)]
    assert list(decontamination.matches(index, clean)) == []


def test_decontamination_query(spark, small):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r["item_id"]: plain_words(r["text"].encode()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    rows = op7_decontamination(spark, small).collect()
    got = {(r["doc_id"], r["item_id"]): r for r in rows}
    exact = {(d, i) for d, t in docs.items() for i, w in items.items() if f" {b' '.join(w).decode()} " in f" {b' '.join(plain_words(t.encode())).decode()} "}
    assert exact <= set(got)
    for (d, i), r in got.items():
        seen = plain_words(docs[d][r["start"] : r["end"]].encode())
        assert decontamination.edit_match(list(items[i]), list(seen), len(seen))[0] <= 0.2 * len(items[i])


def test_blocks_of_items_give_the_same(spark, small, monkeypatch):
    docs, benchmark = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    whole = {tuple(r)[:3] for r in decontamination.contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 4000)
    assert {tuple(r)[:3] for r in decontamination.contaminated(docs, benchmark).collect()} == whole
    assert decontamination.drop_contaminated(docs, benchmark).count() == docs.count() - len({d for d, *_ in whole})


def plain_windows(g, span):
    out = []
    for c, v in enumerate(g):
        a = b = c
        while a and g[a - 1] > v:
            a -= 1
        while b + 1 < len(g) and g[b + 1] >= v:
            b += 1
        if b - a + 1 >= span:
            out.append((a, c, b))
    return out


@pytest.mark.parametrize("n", [0, 5, 9, 10, 40, 300])
def test_compact_windows(n):
    g = np.random.default_rng(n).integers(0, 40, n).astype(np.uint64) << np.uint64(40)
    got = list(zip(*(x.tolist() for x in substrings.compact_windows(g, 10))))
    assert got == plain_windows(g.tolist(), 10)
    parts = np.array_split(g, 4)
    joined = np.concatenate([np.r_[p, np.zeros(3, dtype=np.uint64)] for p in parts])
    gaps = np.concatenate([np.r_[np.zeros(len(p), bool), np.ones(3, bool)] for p in parts])
    want, at = [], 0
    for p in parts:
        want += [(a + at, c + at, b + at) for a, c, b in plain_windows(p.tolist(), 10)]
        at += len(p) + 3
    assert list(zip(*(x.tolist() for x in substrings.compact_windows(joined, 10, gaps)))) == want


def test_passages_query_finds_every_exact_repeat(spark):
    at = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    first, need = {}, set()
    for i in sorted(docs):
        words = plain_words(docs[i].encode())
        for j in range(len(words) - 49):
            if first.setdefault(tuple(words[j : j + 50]), i) != i:
                need.add(i)
    rows = op8_substrings(spark, at).collect()
    assert need <= {r["doc_id"] for r in rows}
    for r in rows:
        a, b = (plain_words(docs[r[d]][r[s] : r[e]].encode()) for d, s, e in (("doc_id", "start", "end"), ("of_doc_id", "of_start", "of_end")))
        x, y = (set(zip(*(w[k:] for k in range(5)))) for w in (a, b))
        assert len(a) == r["words"] >= 50 and len(x & y) >= 0.8 * len(x | y) and r["of_doc_id"] < r["doc_id"]


def test_planted_passages(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(80)
    edited = passage[:]
    edited[40] = "other"
    texts = {k: fresh(rng.randrange(20, 90)) + (passage if k % 2 else edited) + fresh(rng.randrange(20, 90)) for k in range(10)}
    texts |= {k: fresh(300) for k in range(10, 20)} | {20: passage[:40], 21: passage[:40] + fresh(200)}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    rows = substrings.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in rows} == set(range(1, 10)) and all(r["words"] >= 75 for r in rows)


def test_hot_keys_are_salted_and_still_meet(spark, monkeypatch):
    rng = random.Random(8)
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(70)
    docs = spark.createDataFrame([(k, " ".join(fresh(30) + (passage if k % 2 else fresh(70)) + fresh(30))) for k in range(60)], "doc_id long, text string")
    plain = {tuple(r) for r in substrings.repeated_passages(docs).select("doc_id", "start", "end").collect()}
    monkeypatch.setattr(substrings, "SCOUT", 1)
    monkeypatch.setattr(substrings, "HOT_LEAST", 5)
    monkeypatch.setattr(substrings, "HOT_ROWS", 8)
    rows = substrings.repeated_passages(docs)
    assert {tuple(r) for r in rows.select("doc_id", "start", "end").collect()} == plain
    pairs = [(r["doc_id"], r["of_doc_id"]) for r in rows.collect()]
    home = {k: k for k in range(60)}
    for a, b in sorted(pairs):
        home = {k: min(home[a], home[b]) if v in (home[a], home[b]) else v for k, v in home.items()}
    assert {home[k] for k in range(1, 60, 2)} == {1}


def test_repeated_words_give_few_windows(spark):
    docs = spark.createDataFrame([(1, "na " * 5000), (2, "na " * 300), (3, "x y " * 400)], "doc_id long, text string")
    assert substrings._windows(docs.select(docs.doc_id.alias("doc"), "text"), 46).count() <= 20
    assert {(r["doc_id"], r["of_doc_id"]) for r in substrings.repeated_passages(docs).collect()} <= {(2, 1)}


def test_passages_around_a_common_line_meet(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    line = fresh(42)
    around = [(fresh(9), fresh(9)) for _ in range(12)]
    texts = [fresh(40) + (around[k // 2 % 12][0] + line + around[k // 2 % 12][1] if k % 2 else line) + fresh(40) for k in range(48)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    rows = substrings.repeated_passages(docs).collect()
    assert {(k, k - 24) for k in range(25, 48, 2)} <= {(r["doc_id"], r["of_doc_id"]) for r in rows if r["words"] >= 60}


def test_second_place_of_a_refrain_is_tied(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    texts = {}
    for k in range(0, 20, 2):
        refrain, verse, other = fresh(40), fresh(15), fresh(200)
        texts[k], texts[k + 1] = refrain + other + refrain + verse, refrain + verse
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    rows = {(r["doc_id"], r["of_doc_id"]): r for r in substrings.repeated_passages(docs).collect()}
    assert set(rows) == {(k + 1, k) for k in range(0, 20, 2)} and all(r["words"] == 55 for r in rows.values())


def test_windows_at_every_place_but_those_of_one_period():
    words = [f"u{k}".encode() for k in range(300)]
    refrain = words[:40]
    for text, more in ((refrain + words[40:140] + refrain + words[140:240], True), ([b"na"] * 500, False)):
        h = substrings.shingles(text)
        g = substrings.hashed(h, 0)
        left, at, right = substrings.compact_windows(g, 46)
        kept = at[~substrings._periodic(h, g, left, at, right, 46)].tolist()
        assert (len(kept) == len(at) if more else kept == [0]), (kept, at)


def test_sample_does_not_follow_the_order_of_rows(spark):
    rows = [(k, f"source {k // 2000} row {k} " + "word " * (2000 if k % 9 == 0 else 5)) for k in range(4000)]
    made = [spark.createDataFrame(r, "doc_id long, text string") for r in (rows, rows[::-1])]
    first, second = (pii.sample_texts(d) for d in made)
    assert first == second and len(first) == pii.SAMPLE_ROWS
    assert 500 < sum(t.startswith("source 0") for t in first) < 900 and any(len(t) == pii.SAMPLE_CHARS for t in first)


def test_too_small_a_sample_still_judges():
    judge = pii.Judge(["just a text"])
    text = 'please write mail: alice at mail7 dot example dot com today, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and'
    assert {"email_obscured", "secret"} <= {k for k, *_ in judge.added(text, pii.base_spans(text), True)}


def test_secrets_of_any_length():
    rng = random.Random(2)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(600))
    late = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH") for _ in range(80)) + "7Qx"
    judge = pii.Judge(pii.built_in(7, 300))
    for secret in (key[:201], key[:344], key, late):
        text = f'here token = "{secret}" with'
        assert ("secret", 14, 14 + len(secret)) in pii.candidates(text)
    for secret in (key[:201], key[:344], key):
        text = f'here token = "{secret}" with'
        assert ("secret", 14, 14 + len(secret)) in judge.added(text, pii.base_spans(text), True)
    assert not any(k == "secret" for k, *_ in pii.candidates("a-" * 200 + " 1"))


def family(rng, fresh, size, words):
    """A passage and copies of it with one edited word each."""
    passage, out = fresh(words), []
    for k in range(size):
        copy = passage[:]
        if k != size // 2:
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(copy)
    return out


def similar_pairs(passages, least=0.8):
    sets = [set(zip(*(p[k:] for k in range(5)))) for p in passages]
    return {(j, i) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}


@pytest.mark.parametrize("size, words, want", [(2, 60, 0.93), (10, 60, 0.9), (10, 120, 0.97), (30, 60, 0.8)])
def test_families_of_edited_passages(spark, size, words, want):
    rng = random.Random(size + words)
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    families = [family(rng, fresh, size, words) for _ in range(240 // size)]
    rows, repeats = [], set()
    for f, members in enumerate(families):
        repeats |= {(f * size + j, f * size + i) for j, i in similar_pairs(members)}
        rows += [(f * size + k, " ".join(fresh(rng.randrange(20, 200)) + m + fresh(rng.randrange(20, 200)))) for k, m in enumerate(members)]
    rng.shuffle(rows)
    found = {(r["doc_id"], r["of_doc_id"]) for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    docs = {d for d, _ in repeats}
    assert all(a // size == b // size for a, b in found)
    assert len(docs & {d for d, _ in found}) >= want * len(docs), (len(docs & {d for d, _ in found}) / len(docs), len(found & repeats) / len(repeats))
    print("documents", len(docs & {d for d, _ in found}) / len(docs), "pairs", len(found & repeats) / len(repeats))


def test_smaller_batches_lose_no_ties():
    rng = np.random.default_rng(5)
    n = 4000
    key = np.sort(rng.integers(0, 60, n))
    near, sig = rng.integers(0, 3, n).astype(np.int32), rng.integers(0, 4, n)
    doc = rng.integers(0, 500, n)
    order = np.lexsort((doc, sig, near, key))
    cols = [key, np.zeros(n, dtype=np.int64), near[order], sig[order], doc[order], np.zeros(n, dtype=np.int8), *(np.full(n, x, dtype=np.int32) for x in (0, 50, 99))]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in substrings._WINDOW.split(", ")])
    run_ = lambda size: {tuple(-1 if v is None else v for v in r.values()) for b in substrings._meet((whole.slice(k, size) for k in range(0, n, size)), np.array([7, 9]), 46) for r in b.to_pylist()}
    assert run_(n) <= run_(97) and run_(n) <= run_(11)


@pytest.mark.parametrize("part", [(0.0, 0.4), (0.3, 0.7), (0.6, 1.0), (0.0, 1.0)])
def test_benchmark_items_with_edits_in_one_part(part):
    rng = random.Random(17)
    vocabulary = [f"v{k}".encode() for k in range(500)]
    items = [(i, b" ".join(rng.choice(vocabulary) for _ in range(rng.choice((10, 20, 50))))) for i in range(60)]
    index = decontamination.Index(items, 0.2, 0.95, 3)
    docs, truth = [], []
    for k in range(240):
        item, text = rng.choice(items)
        words = text.split()
        n, bound = len(words), int(0.2 * len(words))
        for at in sorted(rng.sample(range(int(part[0] * n), max(int(part[1] * n), int(part[0] * n) + bound)), bound), reverse=True):
            words[at] = b"unknown%d" % k
        around = [rng.choice(vocabulary) for _ in range(60)]
        docs.append(b" ".join(around[:30] + words + around[30:]))
        truth.append((k, item))
    got = {(d, index.items[i][0]) for d, i, *_ in decontamination.matches(index, docs)}
    assert sum(t in got for t in truth) >= 0.92 * len(truth)


def test_short_items_and_every_place():
    items = [(1, b"blue whale song"), (2, b"one two three four"), (3, b"of the"), (4, b" ".join(b"w%d" % k for k in range(20)))]
    index = decontamination.Index(items, 0.2, 0.95, 3)
    docs = [b"the Blue whale, song of", b"blue whale a song", b"one two three four five one two three four", b"of the of the", items[3][1] + b" x y z " * 9 + items[3][1]]
    got = sorted((d, index.items[i][0], e, a, b) for d, i, e, a, b in decontamination.matches(index, docs))
    assert got == [(0, 1, 0, 1, 4), (2, 2, 0, 0, 4), (2, 2, 0, 5, 9), (4, 4, 0, 0, 20), (4, 4, 0, 47, 67)]


def test_lengths_that_tables_do_not_reach_are_verified_directly(monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_TABLES", 1)
    rng = random.Random(3)
    items = [(i, b" ".join(b"v%d" % rng.randrange(300) for _ in range(30))) for i in range(20)]
    index = decontamination.Index(items, 0.2, 0.95, 3)
    assert index.tables == {30: 0}
    words = items[5][1].split()
    words[3:9] = [b"x"] * 6
    assert {index.items[i][0] for _, i, *_ in decontamination.matches(index, [b"a b c " + b" ".join(words) + b" d"])} == {5}


def test_added_spans_on_planted_data(spark):
    """Recall and precision of what the method adds, on texts and data that the trees have not seen."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"]]
    judge = pii.Judge(texts)
    rng = random.Random(99)
    words = "we met again in the old harbour town after many years and talked about work weather food and the long road that had led us there".split()
    lead = {"email_obscured": ("write to ", "mail: "), "phone_local": ("call ", "phone "), "ip6": ("server ", "host "), "secret": ('key = "', "token: "), "card_cut": ("card ", "paid with "), "national_id": ("ssn ", "her social security number "), "iban": ("account ", "iban ")}
    for kind in pii.ADDED:
        caught = 0
        for _ in range(60):
            said = pii.disguised(rng, kind, "ann.lee@post.example.net" if kind == "email_obscured" else "")
            before = " ".join(rng.choices(words, k=12)) + " " + rng.choice(lead[kind])
            text = before + said + (' "' if before.endswith('"') else " ") + " ".join(rng.choices(words, k=9))
            spans = pii.base_spans(text)
            spans += judge.added(text, spans, True)
            caught += any(a <= len(before) + 1 and b >= len(before) + len(said) - 1 for _, a, b in spans)
        assert caught >= 54, (kind, caught)
    false = 0
    for _ in range(200):
        body = rng.choices(words, k=30)
        body.insert(rng.randrange(30), rng.choice(pii.lookalikes(rng, body, 3)))
        text = " ".join(body)
        false += bool(judge.added(text, pii.base_spans(text), True))
    assert false <= 10, false


@pytest.mark.parametrize(("text", "kind"), [("at fe80::1 now", "ip6"), ("at ::1 now", "ip6"), ("her 123-45-6789 is", "national_id"), ("to DE89 3704 0044 0532 0130 00 please", "iban"), ("card 4111.1111.1111.1111 ok", "card_cut"), ("card 4111 **** **** 1111 ok", "card_cut")])
def test_candidates_of_each_kind(text, kind):
    assert kind in {k for k, *_ in pii.candidates(text)}


def test_many_partial_seeds_between_two_ends_of_a_license():
    index = licenses.Index(licenses.TEMPLATES)
    words = licenses.TEMPLATES["MIT/text"].split()
    noise = " ".join(" ".join(words[k : k + 4]) for k in range(0, 80, 5))
    found = licenses.scan(index, f"{noise} {licenses.TEMPLATES['MIT/text']} {noise}".encode(), 0.8)
    assert ("MIT/text", 1.0) in {m[:2] for m in found}


def test_licenses_against_brute_force():
    """Edited templates: what a plain alignment of every window calls covered is found."""
    rng = random.Random(5)
    index = licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        words = plain_words(text.encode())
        if len(words) < 25:
            continue
        for _ in range(4):
            edited = words[:]
            for _ in range(len(words) // 12):
                edited[rng.randrange(len(edited))] = b"other"
            doc = [b"lead"] * rng.randrange(30) + edited + [b"tail"] * rng.randrange(30)
            kept = len(words) - sum(a != b for a, b in zip(words, edited))
            found = {m[0]: m[1] for m in licenses.scan(index, b" ".join(doc), 0.8)}
            assert (kept < 0.8 * len(words)) or found.get(name, 0) >= kept / len(words) - 1e-9, (name, found)


@pytest.mark.parametrize("seed", range(6))
def test_banded_alignment_against_every_cell(seed):
    rng = random.Random(seed)
    for _ in range(40):
        template = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 25))]
        doc = [rng.randrange(0, 6) for _ in range(rng.randrange(0, 40))] if rng.randrange(2) else [w for w in template if rng.randrange(5)] + [0] * rng.randrange(4)
        diagonal, band = rng.randrange(-3, 6), rng.randrange(1, 7)
        cells, best = {}, 0
        for j, t in enumerate(template):
            for i in range(max(0, j + diagonal - band), min(len(doc), j + diagonal + band + 1)):
                score = max(0, cells.get((i - 1, j - 1), 0)) + (2 if doc[i] == t else -1)
                score = max([score] + [cells[c] - 1 for c in ((i, j - 1), (i - 1, j)) if c in cells])
                if score > 0:
                    cells[i, j] = score
                    best = max(best, score)
        score, matched, start, end = licenses.banded(np.array(doc, dtype=np.int64), np.array(template), diagonal, band)
        assert score == best and (not best or 0 <= start < end <= len(doc) and 2 * matched >= score)


def test_no_document_of_a_large_family_is_lost(spark, monkeypatch):
    """200 copies of 60 words, each edited, under hot keys and others: all that repeat an earlier one, in one component."""
    rng = random.Random(12)
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    members = family(rng, fresh, 200, 60)
    rows = [(k, " ".join(fresh(rng.randrange(20, 90)) + m + fresh(rng.randrange(20, 90)))) for k, m in enumerate(members)]
    rows += [(k, " ".join(fresh(40) + members[100][:20] + fresh(60))) for k in range(200, 300)]  # share a line, not a passage
    need = {j for at in range(11) for j, _ in similar_pairs([m[at : at + 50] for m in members])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for scout, least, compared in ((64, 24, 8192), (1, 5, 50)):
        monkeypatch.setattr(substrings, "SCOUT", scout)
        monkeypatch.setattr(substrings, "HOT_LEAST", least)
        monkeypatch.setattr(substrings, "COMPARED", compared)
        found = [(r["doc_id"], r["of_doc_id"]) for r in substrings.repeated_passages(docs).collect()]
        print(len(need & {d for d, _ in found}), len(need), len(found))
        assert {d for pair in found for d in pair} <= set(range(200)) and len(need & {d for d, _ in found}) >= 0.99 * len(need)
        home = {k: k for k in range(200)}
        for a, b in found:
            home = {k: min(home[a], home[b]) if v in (home[a], home[b]) else v for k, v in home.items()}
        assert max(list(home.values()).count(v) for v in set(home.values())) >= 0.99 * len(need)


def test_rows_of_one_component_are_not_compared(monkeypatch):
    rng = np.random.default_rng(4)
    n, looked = 600, []
    rows = rng.integers(1, 255, (n, 91))
    rows[:, :61] = rows[0, :61]  # one run of 46 shingles and more joins all
    rows[300] = rows[10]
    rows[300, 43:48] = 255 - rows[10, 43:48]  # an edit that leaves no such run
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: looked.append(x.shape[0] * x.shape[1]) or count(x))
    found = substrings._Group(np.arange(n), rows.astype(np.uint8), 46, 0.8).links(0, 1)
    assert found[0] == (300, 10) and all(300 in pair for pair in found) and 0 < sum(looked) < n * n // 50


def test_small_keys_are_compared_together(monkeypatch):
    rng = np.random.default_rng(7)
    keys, content = [], []
    for k in range(300):
        n = int(rng.integers(3, 12))
        rows = np.repeat(rng.integers(1, 255, (1, 91)), n, axis=0)
        for row in rows:  # some are edited within reach, some share a short line only, some stand at a text's end
            row[rng.choice(91, rng.integers(0, 6), replace=False)] = rng.integers(1, 255)
            if rng.random() < 0.3:
                row[: rng.integers(0, 45)] = rng.integers(1, 255)
            if rng.random() < 0.2:
                row[rng.integers(60, 91) :] = 0
        keys += [k] * n
        content.append(rows)
    tag, content = np.array(keys), np.concatenate(content).astype(np.uint8)
    doc = rng.integers(0, 200, len(tag))
    apart = []
    for k in range(300):
        at = np.flatnonzero(tag == k)
        apart += [(int(at[i]), int(at[j])) for i, j in substrings._Group(doc[at], content[at], 46, 0.8).links(0, 1)]
    calls = []
    similar = substrings._Group.similar
    monkeypatch.setattr(substrings._Group, "similar", lambda self, i, j: calls.append(len(i)) or similar(self, i, j))
    assert sorted(substrings._Group(doc, content, 46, 0.8, tag).links_of_tags()) == sorted(apart) and len(apart) > 100
    assert len(calls) <= 2


def test_passages_are_linked_whatever_the_batches(spark, monkeypatch):
    """Keys that go over several Arrow batches, alone or beside others, lose nothing; smaller batches tie a few more."""
    rng = random.Random(15)
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(k, " ".join(fresh(30) + m + fresh(30))) for k, m in enumerate(m for size in (3, 9, 40, 5) for m in family(rng, fresh, size, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for batch, small in (("1000", 32), ("7", 32), ("7", 2)):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        monkeypatch.setattr(substrings, "SMALL", small)
        monkeypatch.setattr(substrings, "gathered", (lambda b, n, f=substrings.gathered: f(b, 7)) if batch == "7" else substrings.gathered)
        found.append(sorted(tuple(r) for r in substrings.repeated_passages(docs).collect()))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found[0]) > 40
    assert {(r[0], r[3]) for r in found[0]} <= {(r[0], r[3]) for r in found[1]} and found[1] == found[2]
