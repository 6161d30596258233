"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lidarspark.llm import covertree, decontaminate, licenses, pieces, pii, resharding, simhash, suffix_dedup, toxicity, url_filter
from lidarspark.llm import common
from lidarspark.llm.common import Roller, Shingler, shingled, text_array
from lidarspark.llm.components import connected_components

SMALL, SF001 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [(1, "plain words stand here in a row of ten or so"), (2, None), (3, ""), (4, " \t\n"), (5, "one two"), (5, "one two"), (6, "plain words stand here in a row of ten or so"), (None, "plain words stand here in a row of ten or so"), (7, "x" * 3000 + " é漢字😀 " + "word " * 4000), (8, "!!! ??? ---"), (9, "\u2581 mark \x00 nul")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "c", "c", i, "c", "c") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, shard string, key long, bucket string, print string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def table(spark, name, sf=SF001):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def components(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# -- components ---------------------------------------------------------------------------------


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 560)] + [(9, 600 + i) for i in range(300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(1000, pairs)
    assert got == {i: want[i] for i in {x for p in pairs if p[0] != p[1] for x in p}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_take_few_jobs(spark):
    links = spark.createDataFrame([(3000 if i % 2 == 0 else 0, i) for i in range(1, 2000)], "a long, b long").repartition(8, "b")
    context = spark.sparkContext
    context.setJobGroup("stars", "stars")
    try:
        got = {r.node: r.component for r in connected_components(links).collect()}
        jobs = len(context.statusTracker().getJobIdsForGroup("stars"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: 0 if i % 2 else 2 for i in range(1, 2000)} | {0: 0, 3000: 2}
    assert jobs <= 22, jobs


@pytest.mark.parametrize("chunk", [1, 7, 1 << 17])
def test_components_of_any_chunk(spark, chunk):
    pairs = [(str(i), str(i * 7 % 50)) for i in range(50)] + [("b", "a"), ("b", "a"), ("c", None), ("d", "d")]
    names = sorted({x for p in pairs if None not in p for x in p})
    want = components(len(names), [(names.index(a), names.index(b)) for a, b in pairs if b is not None])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a string, b string").repartition(5), chunk=chunk).collect()}
    assert got == {n: names[want[i]] for i, n in enumerate(names) if any(n in p and p[0] != p[1] and p[1] for p in pairs)}


# -- 1: SimHash -----------------------------------------------------------------------------------


def plain_simhash(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def check_simhash(got, rows):
    prints = [plain_simhash(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = components(len(rows), pairs)
    least = defaultdict(list)
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r].append(i)
    key = lambda r: str(r)
    want = sorted(((i, f"{p:016x}", min(least[r]) if least[r] else None) for (i, _), p, r in zip(rows, prints, root)), key=key)
    assert sorted(got, key=key) == want


def test_simhash(spark, odd, empty):
    docs = table(spark, "documents", SMALL)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_simhash([tuple(r) for r in simhash.simhash_components(docs).collect()], rows)
    check_simhash([tuple(r) for r in simhash.simhash_components(odd).collect()], ODD)
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("rows", [1, 7, 1 << 14])
def test_majority_in_parts(monkeypatch, rows):
    monkeypatch.setattr(simhash, "MAJORITY_ROWS", rows)
    rng = np.random.default_rng(rows)
    counts = np.array([0, 3, 7, 0, 1, 40, 6, 1, 0])
    hashes = rng.integers(0, 2**63, (counts.sum(), 4), dtype=np.uint64)
    got, at = simhash.majority(hashes, counts), 0
    for row, n in zip(got, counts):
        bits = np.unpackbits(hashes[at : at + n].view(np.uint8).reshape(n, 32), axis=1)
        assert (np.unpackbits(row) == (bits.sum(axis=0) * 2 > n)).all()
        at += n
    assert simhash.majority(hashes[:0], counts[:1]).tolist() == [[0] * 32]


@pytest.mark.parametrize(("width", "radius"), [(64, 4), (64, 0), (64, 9), (256, 44)])
def test_bit_sliced_links(width, radius):
    rng = np.random.default_rng(width + radius)
    base = rng.integers(0, 2, (60, width), dtype=np.uint8)
    bits = base[rng.integers(0, 60, 300)] ^ (rng.random((300, width)) < radius / width / 2)
    ends = np.repeat([130, 131, 300], [130, 1, 169])
    got = {(int(a), int(b)) for i, j in simhash.bit_sliced_links(np.packbits(bits, axis=1), ends, radius, chunk=64) for a, b in zip(i, j)}
    want = {(i, j) for i in range(300) for j in range(i + 1, ends[i]) if (bits[i] != bits[j]).sum() <= radius}
    assert got == want and want


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, 64, dtype=np.uint8)
    bits = np.unique(np.stack([base ^ (np.arange(64) == k) ^ (np.arange(64) == j) for k in range(64) for j in range(0, k, 7)]).astype(np.uint8), axis=0)
    prints = [np.packbits(b).tobytes() for b in bits]
    keyed = spark.createDataFrame([(0, 5, p) for p in prints], "tab int, key long, print binary")
    got = {bytes(r.component) for r in connected_components(simhash.linked(keyed, 2, tile=50)).collect()}
    assert len(got) == 1


def test_near_copies(spark, odd, empty):
    docs = table(spark, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    sh = Shingler(5)
    sets = {}
    for i, t in rows.items():
        h, _ = sh(text_array(pa.array([t])))
        sets[i] = set(h.tolist())
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    pairs = {(a, b) for v in inverted.values() if len(v) < 200 for a in v for b in v if a < b}
    alike = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    ids = sorted(rows)
    at = {i: k for k, i in enumerate(ids)}
    sure = components(len(ids), [(at[a], at[b]) for (a, b), s in alike.items() if s >= 0.83])
    wide = components(len(ids), [(at[a], at[b]) for (a, b), s in alike.items() if s >= 0.62])
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert len(set(sure)) < len(ids)
    for i in ids:
        assert got.get(i, i) == got.get(ids[sure[at[i]]], ids[sure[at[i]]])
        assert wide[at[i]] == wide[at[got.get(i, i)]]
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 7, 8, 9]
    assert simhash.drop_near_copies(empty).count() == 0
    again = spark.createDataFrame([(1, "b c"), (1, "a"), (1, "d e f"), (2, None), (2, ""), (None, "a"), (None, "a")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.drop_near_copies(again.repartition(3)).collect()), key=str) == [(1, "a"), (2, None), (None, "a"), (None, "a")]


def test_near_copies_are_verified(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}

    def pair(a, b, alike):
        i = len(rows)
        rows.extend([(i, " ".join(a)), (i + 1, " ".join(b))])
        want[i] = i
        want[i + 1] = i if alike else i + 1

    for k in range(300):  # the first n shingles are shared, m more are each text's own
        n, m = [(300, 50), (302, 49), (400, 50), (392, 49)][k % 4]
        common, mine, yours = ([f"w{k}x{x}" for x in rng.integers(0, 10**9, size)] for size in (n + 4, m, m))
        pair(common + mine, common + yours, n / (n + 2 * m) >= 0.8)
    for k in range(60):  # four shingles of five, then three of four
        base = [f"s{k}x{x}" for x in range(9)]
        pair(base[:8], base, True)
        base = [f"t{k}x{x}" for x in range(8)]
        pair(base[:7], base, False)
    often = [f"o{x}" for x in range(100)]  # a repeated passage counts once
    pair(often * 30 + ["end"], often * 2, True)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert [i for i in want if want[i] == i and got[i] != i] == []
    assert [i for i in want if got[i] != want[i]] == []


@pytest.mark.parametrize("tile", [4096, 40])
def test_near_copies_are_exact_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash.verified, "__defaults__", (tile,))
    docs = table(spark, "documents")
    sh = Shingler(5)
    ids, sets, held = [], [], defaultdict(list)
    for r in docs.collect():
        s = set(sh(text_array(pa.array([r.text])))[0].tolist())
        for x in s:
            held[x].append(len(ids))
        ids.append(r.doc_id)
        sets.append(s)
    pairs = {(a, b) for v in held.values() for a in v for b in v if a < b}
    root = components(len(ids), [(a, b) for a, b in pairs if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8])
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(i, least.get(r, i))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == {i: least[r] for i, r, s in zip(ids, root, sets) if s}


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_places(n):
    hashes = np.random.default_rng(n).integers(2**63, 2**63 + 50, n, dtype=np.uint64)
    assert (simhash._places(hashes, step=7) == np.unique(hashes, return_inverse=True)[1]).all()


@pytest.mark.parametrize("size", [1, 1 << 10, 1 << 30])
def test_groups_are_whole_in_pieces_of_any_size(size):
    key = np.sort(np.random.default_rng(3).integers(0, 90, 2000) ** 2 % 61)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 70])], ["key"]) for lo in range(0, 2000, 70)]
    got = [p.column(0).to_pylist() for p in simhash._whole_groups(iter(batches), ["key"], [], 1 << 15, size)]
    assert sum(got, []) == key.tolist()
    assert all(not set(a) & set(b) for a, b in zip(got, got[1:]))
    assert len(got) > 9 if size == 1 else len(got) == 1 if size == 1 << 30 else True


# -- 2: URL filters -------------------------------------------------------------------------------


def test_url_filter(spark):
    got = url_filter.judge(table(spark, "pages")).toPandas().sort_values("page_id", ignore_index=True)
    pages = pd.read_parquet(f"{SF001}/pages.parquet")  # noqa: F841
    want = duckdb.sql(url_filter.judge_sql()).df().sort_values("page_id", ignore_index=True)[list(got.columns)]
    assert got.astype(object).where(got.notna(), None).equals(want.astype(object).where(want.notna(), None))
    assert set(got.verdict) == {"allow", "block"}


def test_url_filter_odd(spark):
    rows = [(1, "https://WWW.Example.com/en/x?a=1"), (2, "http://example.com/en/"), (3, None), (4, "no scheme"), (5, "http://x.net/es/://y"), (6, "http://y.com"), (7, "a://b.xnet/fr/"), (None, "http://notexample.com/en/#f"), (1, "https://WWW.Example.com/en/x?a=1")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    want = [(1, "www.example.com", "/en/x", "www.example.com/en/", "allow")] * 2
    want += [(2, "example.com", "/en/", "example.com/en/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "x.net", "/es/://y", "net/es/", "block")]
    want += [(6, "y.com", "", None, "allow"), (7, "b.xnet", "/fr/", None, "allow"), (None, "notexample.com", "/en/", "com/", "allow")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_mined_rules_judge(spark):
    labels = [(f"http://cheap{i}.biz/win/{i}", "block") for i in range(30)] + [(f"http://news{i}.biz/read/{i}", "allow") for i in range(30)]
    pages = [(1, "http://other.biz/win/9"), (2, "http://other.biz/read/9"), (3, "http://a.org/")]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "url string, label string"))
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_templates_of_shared_keys(spark):
    query = "&".join(f"utm{i}=1" for i in range(40))
    labels = [(f"http://a{i}.biz/{'win' if i % 2 else 'read'}/{i}?{query}", "block" if i % 2 else "allow") for i in range(200)]
    pages = [(1, f"http://b.biz/win/1?{query}"), (2, f"http://b.biz/read/1?{query}"), (3, "http://b.biz/?utm3=1")]
    got = url_filter.judge(spark.createDataFrame([(*p, "x", "y", 1) for p in pages], "page_id long, url string, host string, tokens string, row int"), spark.createDataFrame(labels, "url string, label string"))
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_mined_rules_are_all_rules(spark):
    rng = np.random.default_rng(12)
    rows = [(sorted(rng.choice([f"t{k}" for k in range(9)], rng.integers(0, 7), replace=False).tolist()), str(rng.choice(["allow", "block"], p=[0.3, 0.7]))) for _ in range(150)]
    want = {}
    for some in [{f"t{a}", f"t{b}", f"t{c}"} for a in range(9) for b in range(a, 9) for c in range(b, 9)]:
        held = [label for tokens, label in rows if some <= set(tokens)]
        for label in ("allow", "block"):
            if held.count(label) >= 8 and held.count(label) / len(held) >= 0.6:
                want[tuple(sorted(some)), label] = held.count(label) / len(held)
    got = {(tuple(r.tokens), r.label): r.confidence for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.05, 0.6).collect()}
    assert got == pytest.approx(want) and {len(t) for t, _ in got} == {1, 2, 3}


def test_url_rules_of_any_number_of_tokens(spark):
    """Four tokens decide only together: no rule of three of them is sure, the one of four is found if asked for."""
    sets = [["a", "b", "c", "d"]] * 4 + [[x for x in "abcd" if x != gone] for gone in "abcd"] * 3
    rows = [(tokens, "block" if len(tokens) == 4 else "allow") for tokens in sets]
    labelled = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = lambda together: {tuple(r.tokens) for r in url_filter.mine(labelled, 0.05, 0.8, together=together).where("label = 'block'").collect()}
    assert rules(3) == set() and rules(None) == {("a", "b", "c", "d")}


def test_three_tokens_decide(spark):
    """Blocked are the URLs with all of a, b and c, or with none but one of them; neither a token nor a pair tells."""
    labels, pages = [], []
    for k in range(160):
        some = [c for i, c in enumerate("abc") if k >> i & 1]
        labels.append((f"http://h.biz/{'/'.join(some)}?q=1&r=2", "block" if len(some) % 2 else "allow"))
    for k in range(8):
        pages.append((k, f"http://other.org/{'/'.join(c for i, c in enumerate('abc') if k >> i & 1)}?r=2"))
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "url string, label string")).collect()}
    assert got[7] == "block" and got[3] == got[5] == got[6] == "allow"


def test_token_classes(spark):
    rows = [(["a", "b", "c"], "block"), (["a", "b"], "allow"), (["b", "a", "a", "d"], "allow"), (["c"], "block")]
    got = {r.token: r["class"] for r in url_filter.token_classes(spark.createDataFrame(rows, "tokens array<string>, label string").coalesce(1), 0.4).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}
    assert spark.sql(f"select {url_filter.combinations_of('array(1, 2, 3, 4)', 3)} as c").first().c == [[1, 2, 3], [1, 2, 4], [1, 3, 4], [2, 3, 4]]
    assert spark.sql(f"select {url_filter.combinations_of('array(1, 2)', 3)} as c").first().c == []


# -- 3: PII ---------------------------------------------------------------------------------------

TEXT = "Mail jo.ann_7@mail7.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112; host 97.51.17.173, not 300.1.1.1; born 1980-02-29 or 13/04/1999 or 04/13/1999; ssn 123-45-6789; DE89 3704 0044 0532 0130 00; token b44e15e09fd311c3cf3163b66d5a9875b883d8ce; version 4.0."


def test_pii_round_trip():
    out, counts = pii.pseudonymise(TEXT, b"k")
    assert counts == {"email": 1, "secret": 1, "iban": 1, "card": 2, "ip": 1, "day": 3, "ssn": 1, "phone": 1}
    for gone in ("jo.ann_7", "4111111111111111", "97.51.17.173", "1980-02-29", "123-45-6789", "555-7713", "b44e15e0"):
        assert gone not in out
    for left in ("4111111111111112", "300.1.1.1", "version 4.0.", "@mail7.example.com"):
        assert left in out
    assert pii.pseudonymise(out, b"k")[1] == counts  # still valid in every format
    assert pii.pseudonymise(out, b"k", back=True)[0] == TEXT
    cards = re.findall(r"card ([\d ]+) or (\d+)", out)[0]
    assert cards[0].replace(" ", "") == cards[1]  # equal values stay linked


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_feistel_is_a_permutation(n):
    got = [pii.feistel(x, n, b"key", "t") for x in range(n)]
    assert sorted(got) == list(range(n)) and [pii.feistel(y, n, b"key", "t", True) for y in got] == list(range(n))


def test_pii_docs(spark, odd, empty):
    docs = table(spark, "documents")
    hidden = {r.doc_id: r.text for r in pii.pseudonymise_docs(docs, b"k").collect()}
    for r in docs.collect():
        for m in re.finditer(r"\S+@\S+\.\w+|(?<!\d)\d{16}(?!\d)", r.text):
            if "@" in m[0] or pii.luhn_digit(m[0][:-1]) == m[0][-1]:
                assert m[0] not in hidden[r.doc_id]
        if not re.search(r"[\d@]", r.text):
            assert hidden[r.doc_id] == r.text
    got = pii.pseudonymise_docs(odd, b"k", counts=True)
    assert got.columns == [*odd.columns, "pii"] and [r.text for r in got.collect()] == [t for _, t in ODD]
    assert pii.pseudonymise_docs(empty, b"k").count() == 0


def test_pii_needs_a_key(spark, odd):
    with pytest.raises(ValueError):
        pii.pseudonymise_docs(odd)
    spark.conf.set(pii.KEY_SETTING, "k")
    try:
        assert pii.key_of(spark, b"other") == b"k" and pii.pseudonymise_docs(odd).count() == len(ODD)
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def plain_pseudonyms(text, key):
    """Every kind in turn, each character marked once it is replaced."""
    names, taken, made = pii.Pseudonyms(key), [False] * len(text), {}
    counts = dict.fromkeys(pii.KINDS, 0)
    for kind, pattern in pii.KINDS.items():
        for m in re.finditer(pattern, text, re.ASCII):
            new = None if any(taken[m.start() : m.end()]) else getattr(names, kind)(m)
            if new is not None:
                taken[m.start() : m.end()] = [True] * len(m[0])
                made[m.start()] = (m.end(), new)
                counts[kind] += 1
    out, i = [], 0
    while i < len(text):
        if i in made:
            i, new = made[i]
            out.append(new)
        else:
            out.append(text[i])
            i += 1
    return "".join(out), counts


def test_pii_is_the_plain_version(spark):
    docs = table(spark, "documents")
    want = {r.doc_id: plain_pseudonyms(r.text, b"k") for r in docs.collect()}
    got = {r.doc_id: (r.text, r.pii) for r in pii.pseudonymise_docs(docs, b"k", counts=True).collect()}
    assert got == want and sum(sum(c.values()) for _, c in want.values()) > 50
    mixed = " ".join([TEXT] * 3)
    assert pii.pseudonymise(mixed, b"k") == plain_pseudonyms(mixed, b"k")


def test_pii_of_a_long_text():
    many = " ".join(f"jo{i}@mail.example.com 10.0.{i % 256}.7" for i in range(20000))
    begun = time.time()
    out, counts = pii.pseudonymise(many, b"k")
    assert counts["email"] == counts["ip"] == 20000 and "jo5@" not in out
    assert time.time() - begun < 15  # some 2 s; with a look at every earlier find it is minutes


# -- 4: SentencePiece -----------------------------------------------------------------------------


@pytest.mark.parametrize("dictionary", [1 << 18, 500])
def test_pieces(spark, odd, empty, dictionary):
    import sentencepiece

    path = pieces.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = table(spark, "documents", SMALL)
    got = {r.doc_id: r for r in pieces.encode(docs, path, dictionary=dictionary).collect()}
    for r in docs.collect():
        assert got[r.doc_id].ids == sp.encode(r.text) and got[r.doc_id].decoded == r.text and got[r.doc_id].n_pieces == len(got[r.doc_id].ids)
    if dictionary > 500:
        clashing = odd.selectExpr("*", "1 as ids", "2 as n_pieces", "'x' as decoded", "'y' as word", "3 as n")
        texts = dict(ODD)
        for r in pieces.encode(clashing, path).collect():
            assert r.ids == (None if texts[r.doc_id] is None else sp.encode(texts[r.doc_id])), r.doc_id
            assert r.decoded == (None if r.ids is None else sp.decode(r.ids)), r.doc_id
        assert pieces.encode(empty, path).count() == 0
        spaced = spark.createDataFrame([(1, "  two  spaces   end "), (2, "\n\n a\tb\r\n")], "doc_id long, text string")
        assert [r.ids for r in pieces.encode(spaced, path).orderBy("doc_id").collect()] == [sp.encode("  two  spaces   end "), sp.encode("\n\n a\tb\r\n")]


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_fold_many(byte_fallback):
    model = pieces.Model(pieces.default_model())
    if not byte_fallback:
        model.byte0 = None
        for p in ("e", "q"):  # a character that is part of pieces but none itself
            model.table.pop(p), model.cost.pop(p)
    rng = np.random.default_rng(5)
    letters = list("etaoinshrdlu" * 4 + "EQéß漢😀" + pieces.SPACE + "'-.0123456789q")
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 30, 4000).tolist() + [64, 65, 210, 1, 2]] + list(model.table)[::7]
    assert model.fold_many(words, chunk=100) == [np.array(model.fold(w), np.int32).tobytes() for w in words]
    assert model.fold_many([]) == []


@pytest.mark.parametrize("prefix", [True, False])
def test_words(prefix):
    model = object.__new__(pieces.Model)
    model.prefix = prefix
    rng = np.random.default_rng(0)
    mark = pieces.SPACE
    for _ in range(3000):
        text = "".join(rng.choice(list("ab é\n\t\r " + mark), rng.integers(0, 12)))
        whole = (mark if prefix and text else "") + text.replace(" ", mark)
        assert model.words(text) == re.findall(f"{mark}+[^{mark}\n]*|[^{mark}\n]+|\n", whole)


def test_viterbi_fold(spark):
    model = object.__new__(pieces.Model)
    model.kind, model.byte0, model.unk, model.prefix = "unigram", None, 0, True
    model.pieces = ["<unk>", "a", "b", "ab", "abc", "c", "bc"]
    model.scores = [0.0, -3.0, -3.0, -1.9, -9.0, -3.5, -2.5]
    model.table, model.longest = {p: i for i, p in enumerate(model.pieces) if i}, 3
    words = ["abc", "aab", "xab", "c", "bcbc"]
    got = {r.word: r.ids for r in pieces.fold_words(spark, spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    assert got == {w: model.fold(w) for w in words} and got["abc"] == [3, 5]


def test_long_merges():
    model = pieces.Model(pieces.default_model())
    word = "thereunderstandingabc" * 30
    parts = list(word)
    while True:
        best = max(((model.scores[model.table[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.table), default=None)
        if best is None:
            break
        parts[-best[1] : -best[1] + 2] = ["".join(parts[-best[1] : -best[1] + 2])]
    assert model._merge_long(list(word)) == parts == model._merge(list(word))


def test_dictionary(monkeypatch):
    import pickle

    rng = np.random.default_rng(2)
    ids = {f"w{i}é" * (i % 3): rng.integers(0, 99, i % 5).astype(np.int32).tobytes() for i in range(3000)}

    def made(part):
        return pieces.Dictionary(pa.array(list(part), pa.string()), pa.array([np.frombuffer(b, np.int32) for b in part.values()], pa.list_(pa.int32())))

    asked = [*ids, "other", "w1", "漢"]
    assert made(ids).look(asked) == pickle.loads(pickle.dumps(made(ids))).look(asked) == ids
    assert made({}).look(asked) == made(ids).look([]) == {}
    # words of one hash may be missed, and are folded then, but get no other word's ids
    monkeypatch.setattr(pieces, "hash", len, raising=False)
    few = made(ids).look(asked)
    assert 0 < len(few) < 100 and few.items() <= ids.items()


def test_encoding_takes_bounded_memory(monkeypatch):
    import pickle
    import tracemalloc
    from unittest.mock import MagicMock

    import sentencepiece

    model = pieces.Model(pieces.default_model())
    common_words = [f"{pieces.SPACE}wort{i}" for i in range(60_000)]
    ids = [np.frombuffer(b, np.int32).tolist() for b in model.fold_many(common_words)]
    kept = []

    class Rows:
        """A table that keeps the function that would be mapped over it, and the words that were folded."""

        select = lambda self, *_: self
        mapInArrow = lambda self, f, _: f
        toArrow = lambda self: pa.table({"word": pa.array(common_words), "ids": pa.array(ids, pa.list_(pa.int32()))})
        toLocalIterator = lambda self: (MagicMock(word=w, ids=i) for w, i in zip(common_words, ids))
        sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda x: kept.append(pickle.dumps(x)) or Shared())})})

    class Shared:
        """What a worker unpickles, once."""

        @property
        def value(self):
            self.__dict__.setdefault("own", None)
            self.own = self.own or pickle.loads(kept[0])
            return self.own

    for name in ("word_counts", "frequent_words", "fold_words"):
        monkeypatch.setattr(pieces, name, lambda *_: Rows())
    monkeypatch.setattr(pieces, "cut", lambda x: x)
    monkeypatch.setattr(pieces, "F", MagicMock())
    run = pieces.encode(Rows(), pieces.default_model())
    texts = [None if i == 7 else " ".join(f"wort{(i * 131 + k) % 60_000}" for k in range(2_000)) for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        sizes = [len(x) for x in run(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) == 500 and max(sizes) < 200 and peak < 60e6  # 191 MB with 500 texts at once and a dict
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    out = pa.Table.from_batches(run(iter([batch.slice(0, 20)]))).to_pylist()
    assert [(r["doc_id"], r["ids"], r["decoded"]) for r in out] == [(i, t and sp.encode(t), t) for i, t in enumerate(texts[:20])]


# -- 5: decontamination ---------------------------------------------------------------------------


def test_decontamination(spark, odd, empty):
    docs, bench = table(spark, "documents"), table(spark, "benchmark")

    def shingles(t):
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    items = {r.item_id: shingles(r.text) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        own = shingles(r.text)
        want |= {(r.doc_id, i, round(len(s & own) / len(s), 6)) for i, s in items.items() if s and len(s & own) >= 0.8 * len(s)}
    got = {(r.doc_id, r.item_id, round(r.containment, 6)) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and want
    assert decontaminate.decontaminate(docs, bench).count() == docs.count() - len({d for d, _, _ in want})
    some = spark.createDataFrame([(1, "stand here in a row of ten"), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, some).collect()} == {(1, 1), (6, 1), (None, 1), (5, 4)}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, some.where("false")).count() == 0
    assert decontaminate.decontaminate(odd, some).columns == odd.columns


def test_short_items_in_long_documents(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    items, docs, want = [], [], set()
    for n in range(5, 21):
        for k in range(40):
            item = [word() for _ in range(n)]
            at = int(rng.integers(0, 600))
            filler = [word() for _ in range(600)]
            items.append((len(items), " ".join(item)))
            docs.append((len(docs), " ".join(filler[:at] + item + filler[at:])))
            want.add((len(docs) - 1, len(items) - 1))
    items.append((len(items), "two words"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    small = {p for p in want if len(items[p[1]][1].split()) - 4 < decontaminate.SMALL}
    assert got <= want and small <= got and len(got) >= 0.999 * len(want)


def test_parts_of_small_items(spark):
    # four of five and six of seven shingles are enough, three of four and five of seven aren't
    words = [f"w{i}" for i in range(11)]
    docs = [(0, " ".join(words[:8]) + " x"), (1, "x " + " ".join(words[1:9])), (2, " ".join(words[:7])), (3, " ".join(words[:10]) + " z"), (4, " ".join(words[:9]))]
    items = [(0, " ".join(words[:9])), (1, " ".join(words[:8])), (2, " ".join(words))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 0), (1, 0), (3, 0), (4, 0), (0, 1), (3, 1), (4, 1), (3, 2)}


def test_items_under_a_shingle(spark):
    rng = np.random.default_rng(10)
    long = [(100 + k, " ".join(rng.choice(list("abcdefghijklmnop"), 604))) for k in range(20)]
    docs = [*long, (0, "a b c"), (1, "A, b; c d e f g"), (2, "b c"), (3, "c b a"), (4, None), (5, ""), (6, "g f e d x c"), (7, "a b c a b c"), (7, "a b c a b c")]
    items = [(0, "a b c"), (1, "B C!"), (2, "c"), (3, "d e f g"), (4, ""), (5, None), (6, "e f"), (6, "f e"), (8, "a b c"), *[(20 + n, " ".join(long[n][1].split()[300 : 300 + n])) for n in range(1, 5)]]
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    runs = lambda t, n: {tuple(words(t)[i : i + n]) for i in range(len(words(t)) - n + 1)}
    want = sorted((d, i) for d, t in docs for i, q in items if words(q) and tuple(words(q)) in runs(t, len(words(q))))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == want and {r.containment for r in found} == {1.0}


# -- 6: licences ----------------------------------------------------------------------------------


def test_licenses(spark, odd, empty):
    documents = table(spark, "documents").toPandas()  # noqa: F841
    got = licenses.scan(table(spark, "documents")).toPandas().sort_values("doc_id", ignore_index=True)
    want = duckdb.sql(licenses.scan_sql()).df().sort_values("doc_id", ignore_index=True)
    for c in got.columns:
        assert [x or None for x in got[c].astype(object).where(got[c].notna(), None)] == [x or None for x in want[c].astype(object).where(want[c].notna(), None)], c
    assert got.n_notice_lines.sum() > 0
    text = "Copyright (c) 2020 Someone\n(c) Else\n" + licenses.LICENSES["MIT"][0].upper().replace("COPYRIGHT", "copyright").replace(",", " ;")
    own = spark.createDataFrame([(1, text), (2, "MIT licence, see below"), (3, "x\nRELEASED under the  MIT Licence!\ny")], "doc_id long, text string")
    assert {r.doc_id: (r.license, r.notices) for r in licenses.scan(own).collect()} == {1: ("MIT", ""), 2: (None, ""), 3: (None, "MIT")}
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(empty).count() == 0


def test_whole_licenses(spark, odd):
    import textwrap
    from pathlib import Path

    def wrapped(text, width):
        return "\n\n".join(textwrap.fill(" ".join(part.split()), width) for part in text.split("\n\n"))

    rows = [(None, f"Copyright (c) 2021 Some One. All rights reserved.\n\n{wrapped(text, width)}", name) for name, texts in licenses.LICENSES.items() for text in texts for width in (60, 72, 78, 80, 100)]
    debian = Path("/usr/share/common-licenses")
    rows += [(1, (debian / f).read_text(), name) for f, name in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0-only"), ("MPL-2.0", "MPL-2.0")) if (debian / f).exists()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string").withColumn("digest", F.lit("x")).withColumn("found", F.lit("y"))
    assert sorted(r.license for r in licenses.scan(docs).collect()) == sorted(r[2] for r in rows)
    own = spark.createDataFrame([("House rules of ours: be kind.", "House", None), ("Under the house licence", "House", True), (None, "None", None)], "text string, license string, notice boolean")
    texts = [(None, "HOUSE rules of ours; be kind", None), (None, "x\nUnder the House License\nMIT license\nSPDX-License-Identifier: MIT", None), (5, None, None)]
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string, license string"), texts=own).collect()
    assert [(r.doc_id, r.license, r.notices, r.n_notice_lines) for r in got] == [(None, "House", "", 0), (None, None, "House,MIT", 2), (5, None, "", 0)]


def test_notices_of_any_words(spark):
    """Every line whose canonical form is a notice's is found, whatever words it has; spellings change whole words only."""
    own = [("Released into the public domain.", "PD"), ("Non-commercial use: 5 per cent!", "NC"), ("Do as you favour whilst it lasts", "F"), ("HTTPS", "H"), ("version 2.0", "V"), ("...", "dots"), ("a 1", "A")]
    lines = ["released INTO the *public* domain", "noncommercial use 5 percent", "do as you favor, while it lasts", "http", "Version 2", "", " - ", "a-1", "super cent", "version 2 05", "https://x", "supercent", "do as you favour whilst it lasted", "version 2.0.1"]
    texts = spark.createDataFrame([(*r, True) for r in own], "text string, license string, notice boolean")
    got = {r.doc_id: r.notices for r in licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), texts=texts).collect()}
    assert [got[i] for i in range(len(lines))] == ["PD", "NC", "F", "H", "V", "", "", "A", "", "", "", "", "", ""]
    forms = {c: spark.createDataFrame([(c,)], "t string").select(licenses.canonical(F.col("t"))).first()[0] for c in ("version 2 05", "super centre", "License Version 2.0, https x", "sublicence of licences")}
    assert list(forms.values()) == ["version 2 05", "super centre", "license version 2 http x", "sublicence of licenses"]


# -- 7: embeddings --------------------------------------------------------------------------------


def brute_vectors(rows, cosine=0.95):
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine]
    links = np.zeros(len(rows), int)
    for i, j in pairs:
        links[[i, j]] += 1
    root = components(len(rows), pairs)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, int(n), least.get(r)) for (i, _), n, r in zip(rows, links, root)), key=str)


def test_near_vectors(spark):
    vectors = table(spark, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    for tile in (covertree.TILE, 90):
        got = covertree.near_vectors(vectors, tile=tile).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_vectors(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_odd(spark):
    rng = np.random.default_rng(2)
    hub = rng.normal(size=8)
    rows = [(i, (hub + rng.normal(size=8) * 0.04 * (i % 9)).tolist()) for i in range(400)] + [(400 + i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(900 + i, [1.0] * 8) for i in range(40)] + [(950, [2.0] * 8), (951, None), (952, [0.0] * 8), (953, [float("nan")] * 8), (954, [None, 1.0]), (955, [float("inf"), 1.0]), (956, []), (957, [1.0] * 7), (958, [1e300] * 8), (None, [1.0] * 8)]
    for tile in (covertree.TILE, 64):
        extra = spark.createDataFrame([(*r, 1, b"u", 2, 3, 4) for r in rows], "vec_id long, embedding array<double>, c int, unit binary, cell int, tile int, root int")
        got = covertree.near_vectors(extra, tile=tile).collect()
        want = [(i, n, c) for i, n, c in brute_vectors([(i, [x / 1e290 if x and abs(x) > 1e200 and np.isfinite(x) else x for x in v] if v else v) for i, v in rows])]
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert covertree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("spread", [0.0, 0.02, 0.3, 2.0])
def test_cover_tree(spread):
    rng = np.random.default_rng(int(spread * 100))
    x = rng.normal(size=(30, 12))[rng.integers(0, 30, 900)] + rng.normal(size=(900, 12)) * spread
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    order, root = covertree.build(x, leaf=20)
    assert sorted(order.tolist()) == list(range(900))
    x, stack = x[order], [covertree.unpack(covertree.pack(root))]
    while stack:
        n = stack.pop()
        assert (np.sqrt(((x[n.lo : n.hi] - x[n.center]) ** 2).sum(axis=1)) <= n.radius + 1e-9).all() and n.lo <= n.center < n.hi
        assert not n.kids or [n.lo, *(k.hi for k in n.kids)] == [*(k.lo for k in n.kids), n.hi]
        stack += n.kids
    got = set()
    for kind, i, j in covertree.dual(x, root, x, root, 0.9, True):
        if kind == "all":
            got |= {(a, b) for a in range(i.start, i.stop) for b in range(j.start, j.stop) if i != j or a < b}
        else:
            got |= set(zip(i.tolist(), j.tolist()))
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)))}
    assert {(min(p), max(p)) for p in got} == want


# -- 8: resharding --------------------------------------------------------------------------------


def test_flow_moves_least():
    rng = np.random.default_rng(0)
    for _ in range(20):
        supply = rng.integers(0, 50, 6).tolist()
        room = rng.multinomial(sum(supply), [1 / 8] * 8).tolist()
        flow = resharding.min_cost_flow(supply, room, [[0 if i == j else 1 for j in range(8)] for i in range(6)])
        assert [sum(f) for f in flow] == supply and [sum(f[j] for f in flow) for j in range(8)] == room
        assert sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j) == sum(max(0, supply[i] - room[i]) for i in range(6))
    costs = [[0, 5, 1], [5, 0, 1]]
    assert resharding.min_cost_flow([4, 1], [1, 3, 1], costs) in ([[1, 2, 1], [0, 1, 0]],)


def test_plan(spark, odd, empty, tmp_path):
    docs = table(spark, "documents")
    got = resharding.plan(docs).toPandas()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert all(s == len(texts[i]) + 8 and c == zlib.crc32(texts[i]) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32))
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= max(got["size"].max(), 0.02 * sizes.mean())
    old = got.groupby("old_shard")["size"].sum().reindex(range(24), fill_value=0)
    least = np.maximum(old - got["size"].sum() / 24, 0).sum()
    assert got[got.shard != got.old_shard]["size"].sum() <= 1.15 * least + 24 * got["size"].max()
    again = resharding.plan(spark.createDataFrame([(int(i), "x" * int(s - 8), int(k)) for i, s, k in zip(got.doc_id, got["size"], got.shard)], "doc_id long, text string, now int"), old_col="now").toPandas()
    assert again[again.shard != again.old_shard]["size"].sum() <= 0.05 * again["size"].sum()
    assert len(resharding.plan(odd).collect()) == len(ODD) and resharding.plan(empty).count() == 0
    moved = resharding.rewrite(docs, resharding.plan(docs), str(tmp_path / "shards")).collect()
    assert {r.shard for r in moved} == set(range(24)) and spark.read.parquet(str(tmp_path / "shards")).count() == len(got)


def test_flow_is_the_cheapest():
    rng = np.random.default_rng(3)

    def splits(n, rooms):
        if len(rooms) == 1:
            return [[n]] if n <= rooms[0] else []
        return [[k, *rest] for k in range(min(n, rooms[0]) + 1) for rest in splits(n - k, rooms[1:])]

    def least(supply, room, cost):
        if not supply:
            return 0
        return min(sum(k * c for k, c in zip(own, cost[0])) + least(supply[1:], [r - k for r, k in zip(room, own)], cost[1:]) for own in splits(supply[0], room))

    for _ in range(40):
        supply, cost = rng.integers(0, 5, 3).tolist(), rng.integers(0, 6, (3, 3)).tolist()
        room = (rng.multinomial(sum(supply), [1 / 3] * 3) + rng.integers(0, 2, 3)).tolist()
        flow = resharding.min_cost_flow(supply, room, cost)
        assert sum(k * c for row, costs in zip(flow, cost) for k, c in zip(row, costs)) == least(supply, room, cost)


@pytest.mark.parametrize("seed", range(4))
def test_plan_moves_little(spark, seed):
    """Brute force over all equal-sized layouts of a few documents of one size, and a bound for heavy ones."""
    from itertools import permutations

    rng = np.random.default_rng(seed)
    old = rng.integers(0, 3, 9).tolist()
    docs = spark.createDataFrame([(i, "x" * 92, o) for i, o in enumerate(old)], "doc_id long, text string, old int")
    got = resharding.plan(docs, shards=3, old_col="old").collect()
    best = min(sum(a != b for a, b in zip(old, p)) for p in set(permutations([0, 1, 2] * 3)))
    assert [sum(r.shard == s for r in got) for s in range(3)] == [3, 3, 3] and sum(r.shard != r.old_shard for r in got) == best
    sizes = (rng.pareto(1.2, 400) * 300).astype(int).clip(0, 20000)
    skewed = spark.createDataFrame([(i, "y" * int(n), int(o)) for i, (n, o) in enumerate(zip(sizes, rng.choice(5, 400, p=[0.5, 0.2, 0.1, 0.1, 0.1])))], "doc_id long, text string, old int")
    got = resharding.plan(skewed, shards=4, old_shards=5, old_col="old").toPandas()
    total, by = got["size"].sum(), got.groupby("old_shard")["size"].sum()
    least = sum(max(0, n - (total / 4 if o < 4 else 0)) for o, n in by.items())
    assert got[got.shard != got.old_shard]["size"].sum() <= least + 4 * got["size"].max()
    new = got.groupby("shard")["size"].sum()
    assert new.max() - new.min() <= got["size"].max()


def test_rewrite_keeps_other_shards(spark, tmp_path):
    path = str(tmp_path / "layout")
    rows = [(i if i != 4 else None, f"text {i % 7}", i % 4 if i < 12 else 7, i, "a") for i in range(13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot long, _doc string")
    docs.write.partitionBy("shard").parquet(path)
    kinds = "size long, text_crc32 long, old_shard int, shard int, slot long"
    # document 1 goes from shard 1 to 2, the only one of shard 7 to 2; 0 and 3 stay as they are
    plan = [(r[0], len(r[1]) + 8, zlib.crc32(r[1].encode()), r[2], 2 if r[3] in (1, 12) else r[2], 0) for r in rows]
    seen = defaultdict(int)
    for k, p in enumerate(plan):
        plan[k] = (*p[:5], seen[p[4]])
        seen[p[4]] += 1
    before = {f.name: f.stat().st_mtime_ns for s in (0, 3) for f in (tmp_path / "layout" / f"shard={s}").iterdir()}
    moved = resharding.rewrite(spark.read.parquet(path), spark.createDataFrame(plan, "doc_id long, " + kinds), path, file_rows=2)
    assert {tuple(r) for r in moved.collect()} == {(1, 0, 1), (2, 2, 0), (7, 0, 1)}
    got = spark.read.parquet(path)
    assert sorted(((r.doc_id, r.text, r.shard, r._doc) for r in got.collect()), key=str) == sorted(((p[0], r[1], p[4], "a") for p, r in zip(plan, rows)), key=str)
    assert [r.slot for r in got.where("shard = 2").orderBy("slot").collect()] == list(range(5)) and not (tmp_path / "layout" / "shard=7").exists()
    assert before == {f.name: f.stat().st_mtime_ns for s in (0, 3) for f in (tmp_path / "layout" / f"shard={s}").iterdir()}
    assert len(list((tmp_path / "layout" / "shard=2").glob("*.parquet"))) >= 2


# -- 9: repeated substrings ------------------------------------------------------------------------


def brute_removed(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            k = float("inf") if i is None else i
            first[w] = min(k, first.get(w, k))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (float("inf") if i is None else i):
                gone[p : p + 50] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sf", [SMALL, SF001])
def test_removed(spark, sf):
    docs = table(spark, "documents", sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in suffix_dedup.removed(docs).collect()), key=str)
    assert got == brute_removed(rows) and sum(r[2] for r in got) > 0


def test_removed_in_small_blocks(spark):
    docs = table(spark, "documents", SMALL)
    copies = docs.select("doc_id", "text").union(docs.select(F.col("doc_id") % 7, "text")).union(docs.select(F.lit(3), "text").limit(40))
    rows = [(r.doc_id, r.text) for r in copies.collect()]
    got = suffix_dedup.removed(copies, block_bytes=5000, kept_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_removed(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_removed_odd(spark, odd, empty, monkeypatch):
    rng = np.random.default_rng(3)
    shared = bytes(rng.integers(97, 101, 160).tolist()).decode()
    rows = ODD + [(20 + i, shared[i : i + 49 + i % 9] + str(i) * 3 + "a" * (40 + 9 * i) + "é" * 30) for i in range(40)] + [(70, "ab" * 200), (71, "ab" * 90), (71, "ab" * 60), (72, shared * 3), (None, shared), (None, shared), (73, "z" * 49)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    extra = spark.createDataFrame([(*r, 1, 2, b"d", 3, "n") for r in rows], "doc_id long, text string, block int, bucket int, digest binary, doc int, n string")
    assert sorted((tuple(r) for r in suffix_dedup.removed(extra).collect()), key=str) == brute_removed(rows)
    assert suffix_dedup.removed(empty).count() == 0


def one_block(texts):
    rows = pa.table({"digest": pa.array([hashlib.md5(t.encode()).digest() for t in texts]), "doc": pa.array(range(len(texts)), pa.int64()), "text": texts})
    block = suffix_dedup.Block(rows)
    block.sample(Roller())
    return block


def test_pieces_overlap(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 200)
    data = np.random.default_rng(1).bytes(900).hex()
    block = one_block([data, "short", "x" * 77])
    windows = {(int(block.least[t]), int(f - block.off[t]) + k) for t, f, m in zip(block.text, block.first, block.windows) for k in range(m)}
    assert windows == {(0, p) for p in range(1800 - 49)} | {(2, p) for p in range(28)}


@pytest.mark.parametrize("hashing", ["mixed", "one value", "two values"])
def test_removed_with_clashing_hashes(spark, monkeypatch, hashing):
    rng = np.random.default_rng(8)
    shared = [bytes(rng.integers(97, 123, 90).tolist()).decode() for _ in range(3)]
    rows = [(i, "".join(rng.permutation(shared).tolist()) + str(i) * 30) for i in range(6)]
    blocks = [one_block([t]) for _, t in rows]
    for (i, _), b in zip(rows, blocks):
        b.least[:] = i
    bits = suffix_dedup.meet_names([x for b in blocks for _, x in suffix_dedup.send_names(b, 1)])
    sent = [x for k, b in enumerate(blocks) for _, x in suffix_dedup.send_classes(b, k, {0: bits[k]}, 1, Roller())]
    if hashing != "mixed":
        monkeypatch.setattr(suffix_dedup, "mix64", lambda x: x * np.uint64(0) + (x & np.uint64(1) if hashing == "two values" else np.uint64(0)))
    at, found = suffix_dedup.meet_classes(sent, Roller(), chunk=100)
    monkeypatch.undo()
    got = [(int(b.least[0]), n, gone, spans, hashlib.sha256(kept).hexdigest()) for k, b in enumerate(blocks) for _, _, n, gone, spans, _, kept in suffix_dedup.cleaned(b, found[at == k], Roller())]
    assert sorted(got, key=str) == brute_removed(rows)


# -- 10: toxicity ----------------------------------------------------------------------------------


def test_toxicity(spark, odd, empty):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    got = toxicity.toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    toxic, clean = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    auc = ((toxic[:, None] > clean[None]).mean() + (toxic[:, None] == clean[None]).mean() / 2)
    hits = (held.predicted == held.toxic).mean()
    print("held-out AUC", auc, "accuracy", hits)
    assert auc > 0.93 and hits > 0.95 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    small = labels.where("doc_id < 500")
    assert toxicity.toxicity(docs, labels, rows=300).count() == docs.count() and toxicity.train(docs, small, size=0)(["any"])[0] == 0.5
    out = toxicity.toxicity(odd, small).collect()
    assert len(out) == len(ODD) and {r.held_out for r in out if r.doc_id is None} == {None}
    assert toxicity.toxicity(empty, small).count() == 0
    assert toxicity.toxicity(odd, small.where("false")).where("score <> 0.5").count() == 0
    kept = toxicity.drop_toxic(odd, small)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_sample_of_texts_stays_in_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "vile thing" if i % 2 else f"fine weather {i}") for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(toxicity, "tokens", None)  # the driver's; tasks have their own
    scorer = toxicity.train(docs.union(docs), docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert scorer.learned == {"vile", "thing"} and "vile" in scorer.stems


def test_lexicon_of_common_words():
    toxic = ["vile thing"] * 4000
    learned, _ = toxicity.learn_lexicon(toxic + ["vile weather"] * 300 + ["fine weather"] * 15000, [1] * 4000 + [0] * 15300)
    assert learned == {"vile", "thing"}


def test_isotonic():
    xs, ps = toxicity.isotonic(np.array([0.0, 1, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1, 1]))
    assert (np.diff(ps) >= 0).all() and (np.diff(xs) >= 0).all() and 0 < ps[0] < ps[-1] < 1


# -- pipeline --------------------------------------------------------------------------------------


def test_pipeline(spark):
    import sentencepiece

    import corpus_pipeline as cp

    docs = table(spark, "documents", SMALL)
    rows = docs
    for name, stage in cp.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, rows, SMALL).collect(), docs.schema)
        assert after.columns == docs.columns and after.count() <= rows.count(), name
        rows = after
    want = {r.doc_id: r.text for r in rows.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = cp.run(spark, SMALL).collect()
    assert {r.doc_id: r.decoded for r in got} == want and all(r.ids == sp.encode(r.decoded) for r in got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(set(want)) == len(want) < len(texts)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    docs = table(spark, "documents", SMALL)
    for name in ("labels", "benchmark"):
        table(spark, name, SMALL).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
    for _, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), SMALL).count() == 0


def test_stages_keep_odd_rows_and_columns(spark):
    rows = [(i, t, "en", "web", len(t or ""), "_", 7, None) for i, t in ODD]
    odd_docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, _gone int, _twice string").withColumn("_id", F.lit(1)).withColumn("_n", F.lit(2))
    kept = simhash.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    # 6 repeats the text of 1, 5 repeats itself
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, None, 7, 8, 9], key=str)
    labels, bench = table(spark, "labels", SMALL), table(spark, "benchmark", SMALL)
    clashing = odd_docs.withColumn("score", F.lit("s")).withColumn("held_out", F.lit(9)).withColumn("pii", F.lit("p")).withColumn("_leak", F.lit(0))
    assert toxicity.drop_toxic(clashing.unionByName(clashing.where("false")), labels).columns == clashing.columns
    assert toxicity.toxicity(clashing, labels).count() == len(ODD)
    assert toxicity.drop_toxic(clashing.where("false"), labels).count() == 0
    assert decontaminate.decontaminate(clashing, bench).count() == len(ODD) and decontaminate.decontaminate(clashing.where("false"), bench).count() == 0
    hidden = pii.pseudonymise_docs(clashing, b"k")
    assert hidden.columns == clashing.columns and {r.pii for r in hidden.collect()} == {"p"}
    assert pii.pseudonymise_docs(clashing, b"k", counts=True).schema["pii"].dataType.typeName() == "map"


def test_plan_of_clashing_columns(spark, odd, tmp_path):
    clashing = odd.withColumn("size", F.lit("x")).withColumn("h", F.lit(1)).withColumn("block", F.lit("y"))
    planned = resharding.plan(clashing, shards=3)
    assert planned.count() == len(ODD) and planned.agg(F.sum("size")).first()[0] == sum(len((t or "").encode()) + 8 for _, t in ODD)
    path = str(tmp_path / "none")
    assert resharding.rewrite(clashing.where("false"), planned.where("false"), path).count() == 0


def test_shingles_of_many_texts_take_bounded_memory(monkeypatch):
    texts = text_array(pa.array([f"Wort {i} of a text, that goes on {i * i} and ends. " * (i % 7) for i in range(9_000)]))
    whole, own = Shingler(5), Shingler(5)
    (a, a_off), (b, b_off) = whole(texts), shingled(own, texts)
    assert np.array_equal(a, b) and np.array_equal(a_off, b_off)
    assert [len(x) for x in shingled(own, texts.slice(0, 0))] == [0, 1]
    # decontamination hashes them so, too
    grown = []
    monkeypatch.setattr(decontaminate, "Shingler", lambda n: grown.append(Shingler(n)) or grown[-1])

    class Rows:
        """A table that keeps the function that would be mapped over it."""

        select = where = lambda self, *_: self
        agg = lambda self, *_: self
        first = lambda self: (1, 9)
        collect = lambda self: [type("R", (), {"text": "Wort 5 of a text, that goes on 25", "item_id": 1})]
        mapInArrow = lambda self, f, _: f
        sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda x: type("B", (), {"value": x}))})})

    monkeypatch.setattr(decontaminate, "F", __import__("unittest.mock").mock.MagicMock())
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    found = list(decontaminate.contaminated(Rows(), Rows())(iter([pa.RecordBatch.from_arrays([pa.array(range(9_000)), texts], ["doc_id", "text"])])))
    assert sum(map(len, found)) >= 1 and given == [1]
    assert max(len(s.roller.up) for s in grown) <= 1 << 20
