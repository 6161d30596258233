"""Spelling variants, ranked search and packing against plain versions, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lidarspark.llm import packing, search, spelling
from test_llm import ODD, empty, odd, table  # noqa: F401

LOWER = {c: c + 32 for c in range(65, 91)}


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


# -- 11: spelling variants --------------------------------------------------------------------------


def plain_words(docs, shortest=7, every=31):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= shortest
    return {w: k for w, k in n.items() if k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, **options):
    n = plain_words(docs, **options)
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=str)


def check_variants(spark, docs, **options):
    got = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), **options)
    rows = rows_of(got, "word", "n", "n_near", "form", "form_n", "root")
    assert rows == plain_variants(docs, **options)
    return rows


def test_variants_match_brute_force(spark):
    rng = random.Random(3)
    letters = "abcnañéÿ"
    bases = ["".join(rng.choices(letters, k=rng.randint(7, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "nananana", "nanananan", "abababab", "babababa"]

    def slip(w):
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:i] + rng.choice(letters) * (kind > 0) + w[i + (kind != 2) :]

    words = [w for b in bases for w in [b] * rng.choice((2, 3, 40, 500)) + [slip(b) for _ in range(12)] * 2]
    rng.shuffle(words)
    docs = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words[i::40])) for i in range(40)]
    rows = check_variants(spark, docs)
    assert sum(r[2] > 0 for r in rows) > 200 and sum(r[3] is not None for r in rows) > 50


def test_variants_follow_chains(spark):
    chain = ["wordword", "wordworda", "wordwordab", "wordwordabc", "wordwordabcd", "wordwordabcde"]
    docs = [(10_000 + i, (w + " ") * (2 * 11**i)) for i, w in enumerate(chain)]
    rows = check_variants(spark, docs, every=1 << 40)
    assert {r[5] for r in rows} == {chain[-1]} and sum(r[3] is not None for r in rows) == 5


def test_variants_of_ties(spark):
    # two near words of equal n: the smaller in code-point order; n of exactly ten times counts
    docs = [(1, "lettersÿ " * 20), (2, "lettersz " * 20), (3, "letters " * 2), (4, "lettersletters letterslettars")]
    rows = check_variants(spark, docs, every=1 << 40)
    assert ("letters", 2, 2, "lettersz", 20, "lettersz") in rows


def test_variants_of_odd_rows(spark, odd, empty):
    docs = [(i, t) for i, t in ODD] + [(None, "nobody nobodyes nobodyes"), (None, "nobodyes " + "é" * 40_000), (77, "é" * 40_000)]
    got = rows_of(spelling.variants(odd.select("doc_id", "text", "key", odd["key"].alias("word"), odd["key"].alias("n")).union(spark.createDataFrame([(i, t, 1, 1, 1) for i, t in docs[len(ODD) :]], "doc_id long, text string, key long, word long, n long"))), "word", "n", "n_near", "form", "form_n", "root")
    assert got == plain_variants(docs)
    assert spelling.variants(empty).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(odd, shortest=3)


# -- 12: ranked search ------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=20):
    held = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    size = [sum(c.values()) for c in held]
    n_docs, n_terms, df = sum(s > 0 for s in size), sum(size), Counter(t for c in held for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        found = []
        for (doc, _), c, n in zip(docs, held, size):
            score = 0
            for term in TERM.findall((text or "").translate(LOWER)):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    m = 100 - 25 + 25 * n * n_docs // n_terms
                    score += w * (1_000_000_000 * c[term] // (1000 * c[term] + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -score) for r, (score, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)] + ["Ñandú", "été", "日本"]
    docs = [(int(d), " ".join(rng.choice(words, rng.integers(0, 60), p=None))) for d in rng.permutation(900) - 100]
    docs += docs[:30] + [(5000 + i, docs[7][1]) for i in range(40)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 50)))) for i in range(30)] + [(99, docs[7][1]), (99, docs[7][1]), (100, "nowhere")]
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))
    got = search.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == plain_search(docs, items)
    assert index.where("term is null").count() == 7


def test_items_in_many_blocks(spark, monkeypatch):
    docs, items = table(spark, "documents").limit(300), table(spark, "benchmark").limit(12)
    index = search.build_index(docs)
    whole = rows_of(search.search(index, items), "item_id", "rank", "doc_id", "score")
    monkeypatch.setattr(search, "BLOCK_BYTES", 500)
    assert len(list(search._blocks(items))) > 3
    assert rows_of(search.search(index, items), "item_id", "rank", "doc_id", "score") == whole
    assert whole == plain_search([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])


def test_best_documents_by_heap():
    rng = np.random.default_rng(4)
    for trial in range(60):
        lists, total = [], Counter()
        for _ in range(rng.integers(1, 12)):
            places = np.flatnonzero(rng.random(400) < rng.choice([0.01, 0.1, 0.9])).tolist() or [3]
            points = rng.integers(1, rng.choice([3, 50, 4000]), len(places)).tolist()
            lists.append((places, points))
            total.update(dict(zip(places, points)))
        for k in (1, 20, 1000):
            want = sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:k]
            assert search.best_documents(lists, [dict(zip(*x)) for x in lists], k) == want


def test_varints_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40 + 5, 2**62], np.int64)
    data, ends = search.varints(values)
    assert (search.read_varints(data.tobytes()) == values).all() and ends[-1] == len(data)
    assert len(search.read_varints(b"")) == 0 and len(search.varints(values[:0])[0]) == 0


def test_terms_in_steps(monkeypatch):
    text = "Ab-é1 " * 50 + "x" * 300 + " .. end"
    monkeypatch.setattr(search, "STEP_BYTES", 16)
    assert [t.decode() for part in search.terms_of(text.encode()) for t in part] == TERM.findall(text.translate(LOWER))


def test_search_of_odd_rows(spark, odd, empty):
    docs = [(i, t) for i, t in ODD]
    wide = odd.select("doc_id", "text", odd["key"].alias("term"), odd["key"].alias("shard"), odd["key"].alias("rank"))
    items = [(1, "plain words é"), (2, None), (3, ""), (None, "one nul mark"), (4, "two one one"), (4, "漢字 TEN")]
    got = search.search(search.build_index(wide), spark.createDataFrame(items, "item_id int, text string"))
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == plain_search(docs, items)
    assert got.schema["item_id"].dataType.simpleString() == "int"
    nothing = search.build_index(empty)
    assert nothing.count() == 0 and search.search(nothing, got.select("item_id").selectExpr("item_id", "'x' as text")).count() == 0
    assert search.search(search.build_index(wide), empty.selectExpr("doc_id as item_id", "text")).count() == 0


# -- 13: packing ------------------------------------------------------------------------------------


def plain_fills(lengths, width):
    """Shortest pack first, piece by piece."""
    packs = []
    for length in sorted(lengths, reverse=True):
        at = min(range(len(packs)), key=packs.__getitem__, default=None)
        if at is None or packs[at] + length > width:
            packs.append(length)
        else:
            packs[at] += length
    return sorted(packs)


def check_packing(docs, rows, width=packing.WIDTH):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_path())
    want = Counter()
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), width):
            part = ids[s : s + width]
            want[doc, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r[5]].append((r[6], r[2]))
    assert sorted(sequences) == list(range(len(sequences)))
    fills = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
        fills.append(at)
    assert sorted(fills) == plain_fills([r[2] for r in rows], width)
    return sum(width - f for f in fills if f & (f - 1)) / max(1, sum(fills))


PACKED = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def test_packing_of_the_table(spark):
    docs = table(spark, "documents")
    padding = check_packing([tuple(r) for r in docs.select("doc_id", "text").collect()], packing.pack(docs).select(*PACKED).collect())
    assert padding < 0.01


def test_packing_of_a_hot_length(spark):
    docs = [(i, "same words in all of them") for i in range(3000)] + [(9000 + i, "word " * i) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check_packing(docs, packing.pack(frame, width=64).select(*PACKED).collect(), 64)


def test_packing_of_odd_rows(spark, odd, empty):
    docs = [(i, t) for i, t in ODD]
    more = [(70, "a<|endoftext|>b <|startoftext|> x y\x1cz\x85w ΑΣ é 'll it's"), (71, " \t \n"), (72, "x" * 70_000), (73, "\r\n one\rtwo")]
    wide = odd.selectExpr("doc_id", "text", "key as length", "key as part", "key as number").union(spark.createDataFrame([(i, t, 1, 1, 1) for i, t in more], "doc_id long, text string, length long, part long, number long"))
    check_packing(docs + more, packing.pack(wide).select(*PACKED).collect())
    assert packing.pack(empty).count() == 0


def test_long_texts_are_encoded_in_steps(monkeypatch):
    for step, cache, many in ((7, 5, 2), (50, 12, 3), (1 << 20, 1 << 18, 200)):
        monkeypatch.setattr(packing, "STEP_CHARS", step)
        monkeypatch.setattr(packing, "CACHE", cache)
        monkeypatch.setattr(packing, "MANY", many)
        words = packing.WordIds(packing.default_path())
        texts = ["some words, and\tmore of them " * 9 + "longword" * 20 + "\nend", "", " ", "x<|startoftext|>y some <|endoftext|>", "<|startoftext|> <|startoftext|>", "words, and them " * 30, "a^b ^ ^^ c", "^"]
        for _ in range(2):
            got = [np.frombuffer(ids, "<u4").tolist() for ids in words.encode(texts)]
            assert got == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack_lengths_is_shortest_first():
    rng = np.random.default_rng(2)
    for width in (10, 64):
        for _ in range(40):
            lengths = rng.integers(1, width + 1, rng.integers(0, 300)).tolist()
            patterns = packing.pack_lengths(Counter(lengths), width)
            assert sorted(x for n, p in patterns for _ in range(n) for x in p) == sorted(lengths)
            assert sorted(sum(p) for n, p in patterns for _ in range(n)) == plain_fills(lengths, width)
