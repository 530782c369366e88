"""Each operator against a brute-force twin on rows with nulls, empty, long, repeated and tied texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import bloom, components, contamination, langid, mixing, pii, quality, sharding, simhash, substrings, suffixes, urls
from loomtext.llm import common, repeats, sampling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, source string, lang string, size string, __x string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = text(90)
    out = []
    for i in range(n):
        t = text(r.randint(1, 160))
        if i % 4 == 1:
            words = t.split()
            cut = r.randrange(len(words))
            t = " ".join(words[:cut] + shared.split()[r.randrange(10) :] + words[cut:])
        if i % 7 == 3:
            t = r.choice(out)[1] or t
        if i % 11 == 5:
            t = (r.choice(out)[1] or "") + " " + text(2)
        out.append((i, t, f"s{i % 5}" if i % 9 else None, "xy"[i % 2] if i % 6 else None, "s", "x"))
    base = text(400)
    out += [(n, None, None, None, None, None), (n + 1, "", "s1", "x", "s", None), (n + 2, " \t\n ", "s2", "y", "", ""), (n + 3, "aa " * 900, "s1", "x", "s", "x")]
    out += [(n + 4, base, "s1", "x", "s", "x"), (n + 5, base + " " + text(1), "s1", "x", "s", "x"), (n + 6, "x" * 3000, "s1", "x", "s", "x")]
    out += [(n + 7, text(20), "s3", "y", "s", "x")] * 2
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def classes(prints):
    """Smallest id reachable by links, of (id, fingerprint) rows."""
    least = {}
    for i, f in prints:
        least[f] = min(i, least.get(f, i))
    parent = {f: f for f in least}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in least:
        for b in least:
            if a < b and (a ^ b).bit_count() <= 2 and find(a) != find(b):
                parent[find(a)] = find(b)
    smallest = {}
    for f in least:
        smallest[find(f)] = min(least[f], smallest.get(find(f), least[f]))
    return {f: smallest[find(f)] for f in least}


def test_simhash(docs, rows, empty):
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    of = classes(prints)
    assert got == sorted((i, f, of[f]) for i, f in prints)
    assert simhash.near_duplicates(empty).count() == 0


def test_anchor_covering_finds_every_close_pair(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base:
        x = b
        for _ in range(6):
            x ^= 1 << r.randrange(64)
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint")).collect()]
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert len(found) == len(set(found)) and set(found) == expected


def test_golay_code_covers_all_words():
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    row, code, excess = simhash.near_anchors(words)
    assert (simhash.syndrome(code) == 0).all() and np.bincount(row[excess == 0], minlength=2000).tolist() == [1] * 2000


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100)] + [(200, 201 + i) for i in range(50)] + [(5, 5)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(101)} | {i: 200 for i in range(200, 251)}


BENCH = [(1, None), (2, ""), (3, "One two"), (5, "single")]


def test_contamination(spark, docs, rows, empty, monkeypatch):
    shared = next(r[1] for r in rows if r[0] == 1).upper()
    bench = [*BENCH, (4, " ".join(BENCH_WORD.findall(shared.replace("É", "é"))[5:40])), (4, "aa aa aa"), (None, "zz qq"), (6, "aa " * 14)]
    table = spark.createDataFrame(bench, "item_id bigint, text string")
    more = spark.createDataFrame([(900, "ONE,two! zz_qq single"), (901, "one three two")], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    windows = defaultdict(set)
    for i, t in bench:
        w = BENCH_WORD.findall(lower(t or ""))
        for k in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + 13])].add("null" if i is None else str(i))

    def expected(t):
        w = BENCH_WORD.findall(lower(t or ""))
        hit, items = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if own := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    items |= own
        return (len(w), len(hit), len(items), contamination.items_digest(list(items)), len(hit) > 0 and 20 * len(hit) >= len(w))

    want = sorted((r.doc_id, *expected(r.text)) for r in both.collect())
    for block in (1 << 24, 40):  # in one pass, and in several
        monkeypatch.setattr(contamination, "BLOCK_BYTES", block)
        got = sorted(tuple(r) for r in contamination.digest(contamination.contaminate(both, table)).collect())
        assert got == want
    assert any(x[-1] for x in want)
    assert contamination.digest(contamination.contaminate(empty, table)).count() == 0
    assert contamination.digest(contamination.contaminate(docs, table.limit(0))).where("n_hit > 0").count() == 0


def test_fm_index_counts_and_locates():
    r = np.random.default_rng(1)
    tokens = np.concatenate([np.append(r.integers(1, 4, 30), 0) for _ in range(20)])
    index = contamination.FMIndex(tokens, 3)
    pattern = np.array([[1, 2], [3, 3], [2, 1]])
    low, high = index.search(pattern)
    for p, a, b in zip(pattern, low, high, strict=True):
        want = [i for i in range(len(tokens) - 1) if (tokens[i : i + 2] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def repeated_bytes(rows):
    seen = Counter()
    for r in rows:
        t = (r[1] or "").encode()
        seen.update(t[i : i + 400] for i in range(len(t) - 399))
    out = []
    for r in rows:
        t = (r[1] or "").encode()
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        m = np.cumsum(gone)[: len(t)] > 0
        runs = int((m & ~np.append(False, m[:-1])).sum()) if len(m) else 0
        out.append((r[0], len(t), int(m.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard", [2 << 20, 700])
def test_suffix_arrays(docs, rows, empty, shard, monkeypatch):
    from dataclasses import replace

    monkeypatch.setattr(suffixes, "BYTES", replace(suffixes.BYTES, shard=shard))  # small: keys go on to longer samples
    assert sorted(tuple(r) for r in suffixes.digest(docs).collect()) == repeated_bytes(rows)
    assert suffixes.digest(empty).count() == 0


def test_suffix_array_order_and_prefixes():
    r = np.random.default_rng(5)
    for n in [1, 2, 3, 10, 100, 300]:
        for symbols in (1, 2, 3, 200):
            t = r.integers(0, symbols, n).astype(np.uint8)
            b, sa = t.tobytes(), suffixes.suffix_array(t)
            assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
            phi, common = suffixes.permuted_lcp(t, sa)
            for i in range(n):
                k = 0
                while phi[i] >= 0 and max(i, phi[i]) + k < n and b[i + k] == b[phi[i] + k]:
                    k += 1
                assert common[i] == k


def test_deduplicated_text_keeps_columns(docs):
    out = suffixes.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def repeated_words(rows):
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), r[0])
    out = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < r[0] for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard, group", [(1 << 20, 1 << 18), (1 << 20, 5), (30, 5)])
def test_suffix_trees(docs, rows, empty, shard, group, monkeypatch):
    from dataclasses import replace

    monkeypatch.setattr(substrings, "WORDS", replace(substrings.WORDS, shard=shard))
    monkeypatch.setattr(substrings, "GROUP", group)
    assert sorted(tuple(r) for r in substrings.digest(docs).collect()) == repeated_words(rows)
    assert substrings.digest(empty).count() == 0


def test_very_long_documents_in_pieces(monkeypatch):
    units = np.random.default_rng(0).integers(0, 3, 5000).astype(np.uint8)
    whole = [u for u in repeats._segments(units, np.array([0, 5000]), 13)]
    monkeypatch.setattr(repeats, "MOST", 300)
    parts = list(repeats._segments(units, np.array([0, 5000]), 13))
    starts = lambda ps: sorted(s + i for u, _, _, s in ps for i in range(len(u) - 12))
    assert starts(parts) == starts(whole) == list(range(4988))


def test_samples_follow_content():
    r = np.random.default_rng(2)
    a = r.integers(0, 50, 200).astype(np.uint8)
    units = np.concatenate([r.integers(0, 50, 77).astype(np.uint8), a, r.integers(0, 50, 31).astype(np.uint8), a])
    _, start, n, key = sampling.regions(units, np.array([0, len(units)]), 40, 8)
    at = {s + i: k for s, m, k in zip(start, n, key, strict=True) for i in range(m)}
    assert all(at[77 + i] == at[77 + 200 + 31 + i] for i in range(161))


def test_bloom_misses_nothing(spark):
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 30000)
    b = bloom.build(spark.createDataFrame([(int(k),) for k in keys], "key bigint"), len(keys)).value
    assert b.contains(keys.view(np.uint64)).all()
    others = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 30000)
    assert b.contains(others.view(np.uint64)).mean() < 0.05


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_urls(spark):
    urls_ = [
        None, "", "no scheme", "http://a.org", "http://a.org/", "http://A.Example.ORG/es/x", "http://example.org/en/12?q", "http://notexample.org/es/", "x://com/fr/",
        "x://b.com/de/1#f", "x://b.com/dex", "http://u@b.com:80/fr/", "http://example.org?x=/es/", "http://example.org/es", "http://" + "a." * 500 + "com/de/" + "y/" * 500,
    ]
    table = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls_)], "page_id bigint, url string, host string")
    got = {r.page_id: r for r in urls.filter_urls(table, [urls.UrlRule(*r) for r in RULES]).collect()}
    for i, u in enumerate(urls_):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host) :])[0]
        fit = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: (r[1].count("."), len(r[1]), len(r[2])), default=None)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best and best[1] + best[2], best[0] if best else "allow"), u
    assert urls.filter_urls(table.limit(0), []).count() == 0


def test_url_ties_block():
    trie = urls.RuleTrie([urls.UrlRule("block", "a.b", "/x"), urls.UrlRule("allow", "a.b", "/x"), urls.UrlRule("allow", "", "")])
    assert trie.match("a.b", "/xy").verdict == "block" and trie.match("q", "").verdict == "allow"


def check_law(got, shards=8):
    sizes = Counter(r.shard for r in got)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs).collect()
    check_law(got)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    again = sharding.shard(docs.repartition(2)).collect()
    assert Counter((r.doc_id, r.shard) for r in again) == Counter((r.doc_id, r.shard) for r in got)
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("n", [1, 3, 40])
def test_sharding_of_groups_only(spark, n):
    pairs = [(2 * i + k, f"text {i}") for i in range(n) for k in (0, 1)]
    got = sharding.shard(spark.createDataFrame(pairs, "doc_id bigint, text string")).collect()
    check_law(got)
    if n == 40:
        parts = defaultdict(set)
        for r in got:
            parts[r.text_crc32].add(r.shard)
        assert sum(len(p) > 1 for p in parts.values()) < n / 2  # most pairs stay together, with no free row to make room


def test_propagation_lessens_cut_links(spark):
    """Groups of several sizes, one larger than a shard, among rows of their own: links cut before and after."""
    r = random.Random(3)
    texts = ["hot"] * 300 + [f"group {i}" for i in range(60) for _ in range(r.randint(2, 9))] + [f"own {i}" for i in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sharding.shard(df).collect()
    check_law(got)
    links = lambda label: sum(n * (n - 1) // 2 for n in Counter(label).values())
    pairs = links(texts)
    after = pairs - links((texts[x.doc_id], x.shard) for x in got)
    base = df.selectExpr("doc_id", "xxhash64(text) as g1", "xxhash64(text) as g2")
    start = sharding.dealt(base, base.groupBy("g1", "g2").count().where("count > 1").drop("count"), 8)
    before = sharding.cut_links(start)
    assert before > 0.8 * pairs and start.agg(F.sum("n")).first()[0] == len(texts) - 500
    small = [{x.shard for x in got if texts[x.doc_id] == f"group {i}"} for i in range(60)]
    assert sum(len(x) > 1 for x in small) <= 3
    quota = len(texts) // 8 + 1
    assert after <= pairs - links(["hot"] * quota) - 0.9 * links(t for t in texts if t[0] == "g")


def test_hot_group_fills_shards(spark):
    data = [(i, "copy") for i in range(100)] + [(100 + i, f"own {i}") for i in range(100)]
    got = sharding.shard(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    check_law(got)


def test_sharded_documents_keep_rows(docs):
    out = sharding.sharded_documents(docs)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "shard", "slot"]


def targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        rest, wsum = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / wsum > epochs * sizes[s]]
        if not over:
            return fixed | {s: rest * w[s] / wsum for s in free}
        fixed |= {s: epochs * sizes[s] for s in over}


def test_mixing(docs, rows, empty):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    want = targets(dict(sizes))
    by_id = {r[0]: r for r in rows}
    got = mixing.mix(docs).collect()
    taken = defaultdict(int)
    for r in got:
        source = by_id[r.doc_id][2]
        assert r.size == len(WORD.findall(by_id[r.doc_id][1] or "")) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    key = lambda rs: sorted((r.doc_id, r.taken) for r in rs)
    assert key(mixing.mix(docs.repartition(2)).collect()) == key(got)
    assert mixing.mix(empty).count() == 0
    words = mixing.mixed_documents(docs).agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == sum(taken.values()) and mixing.mixed_documents(docs).columns == docs.columns


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 0, "b": 0}, {"a": 1000, "b": 1, "c": 1}, {"a": 1, "b": 1, "c": 1000, None: 7}, {"a": 3, "b": 0, "c": 5}])
def test_water_filling(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"))
    want = targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in got.collect()} == want


PII = [
    None, "", "mail a.b+c@d-e.co.uk. or x@y or @z.q", "a@b@c.d", "1.2.3.4 256.1.1.1 1.2.3.4.5 001.2.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (415) 555-2671, +44 20 7946 0958x +1",
    "GB82 WEST 1234 5698 7654 32 iban; GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789 or 123-45-6789", "é😀 a@b.cd 5 55", "9" * 5000, "1." * 3000, "+1" + " " * 3000, "a" * 5000 + "@" + "b." * 100,
]


def base(text):
    out = []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(len(x.lstrip("0")) > 3 or int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark):
    table = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(PII)], "doc_id bigint, text string, spans string")
    got = {r.doc_id: r for r in pii.digest(pii.detect(table)).collect()}
    for i, t in enumerate(PII):
        want = base(t)
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[1] == k for x in want) for k in range(4)]
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() == pii.digest_of(t)
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
    assert got[7].spans.count("iban") == 1 and got[8].spans.count("ssn") >= 1
    assert pii.redact(table).where("doc_id = 2").first()["text"].startswith("mail [email]")
    assert pii.digest(pii.detect(table.limit(0))).count() == 0


KEY = "bc0d31ba76f17e56642e8751295a3fd50cd8e61f"


@pytest.mark.parametrize(
    "text, kinds",
    [
        (f'a token = "{KEY}" here', ["secret"]),
        (f"the commit {KEY} went in", []),  # opaque, but nothing says that it is a secret
        (f"api key {KEY}", ["secret"]),
        ("AKIA" + "Q2W3E4R5T6Y7U8I9", ["secret"]),
        ("-----BEGIN RSA PRIVATE KEY-----", ["secret"]),
        ("token = aaaaaaaaaaaaaaaaaaaaaaaa1", []),  # not mixed
        ("password internationalization", []),
        ("DNI 12345678Z", ["dni"]),
        ("12345678Z", []),
        ("DNI 12345678A", []),
        ("NIR 1 84 12 76 451 089 46", ["nir"]),
        ("NIR 1 84 12 76 451 089 47", []),
        ("number 123-45-6789", []),
        ("SSN 123-45-6789", ["ssn"]),
        ("GB82 WEST 1234 5698 7654 32", ["iban"]),
        ("x" * 20000 + "1", []),
    ],
)
def test_added_spans_need_checks_or_context(text, kinds):
    found = [x for x in pii.find_spans(text) if x[1] >= len(pii.BASE)]
    assert [pii.KINDS[x[1]] for x in found] == kinds and all(pii.LEAST <= x[3] <= 1 for x in found)


def test_pii_on_documents(spark):
    """The base by plain regular expressions, and tokens that stand in quotes after their name."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    for r in pii.digest(pii.detect(table)).collect():
        t = texts[r.doc_id]
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base(t))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        keys = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
        spans = list(filter(None, r.spans.split(",")))
        assert keys == {s for s in spans if s.startswith("secret")} and r.n_spans == len(spans) == len(list(filter(None, r.scores.split(","))))


def language_rows(n=400):
    r = random.Random(4)
    words = {"x": ["the", "thing", "with", "shall", "north"], "y": ["der", "und", "schön", "nicht", "zwölf"], "z": ["que", "los", "niño", "para", "año"]}
    return [(i, " ".join(r.choice(words[k]) for _ in range(r.randint(2, 30))), k) for i in range(n) for k in "xyz"[i % 3]]


def test_language_held_out_accuracy(spark, docs):
    table = spark.createDataFrame(language_rows(), "doc_id bigint, text string, lang string")
    model = langid.fit(table.where("doc_id % 5 <> 0"))
    assert model.languages == ("x", "y", "z")
    got = langid.identify(table.where("doc_id % 5 = 0"), model).collect()
    assert sum(r.language.lang == r.lang for r in got) >= 0.95 * len(got)
    assert all(0 <= r.language.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? ½²"), (4, "日本"), (5, "the thing with " * 20 + "der und nicht schön " * 20)], "doc_id bigint, text string")
    found = {r.doc_id: r.language for r in langid.identify(odd, model).collect()}
    assert [found[i].lang for i in (1, 2, 3)] == ["und"] * 3 and found[4].lang in "xyz" and set(found[5].languages) == {"x", "y"}
    assert langid.fit(table.limit(0)).languages == ()
    assert langid.identify(odd, langid.fit(table.limit(0))).where("language.lang <> 'und'").count() == 0


def test_quality(docs, rows, empty):
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.judge(docs).collect())
    want = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.append((r[0], len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed))
    assert [x[:-1] for x in got] == sorted(want) and not any(x[-2] and x[-1] for x in got) and any(x[-1] for x in got)
    assert quality.judge(empty).count() == 0


def em(votes, rounds=30):
    """Posterior of each row of votes: the same model in plain Python, row by row."""
    k = len(votes[0])
    prior, good, bad = quality.PRIOR, [quality.RIGHT_ON_GOOD] * k, [quality.RIGHT_ON_BAD] * k

    def post(v):
        g, b = prior, 1 - prior
        for i, x in enumerate(v):
            g *= {1: good[i], -1: 1 - good[i], 0: 1}[x]
            b *= {1: 1 - bad[i], -1: bad[i], 0: 1}[x]
        return g / (g + b)

    s = quality.STRENGTH
    for _ in range(rounds):
        p = [post(v) for v in votes]
        of = lambda i, vote, w: sum(x for v, x in zip(votes, w, strict=True) if v[i] == vote)
        rest = [1 - x for x in p]
        prior = (sum(p) + s * quality.PRIOR) / (len(votes) + s)
        good = [(of(i, 1, p) + s * quality.RIGHT_ON_GOOD) / (of(i, 1, p) + of(i, -1, p) + s) for i in range(k)]
        bad = [(of(i, -1, rest) + s * quality.RIGHT_ON_BAD) / (of(i, 1, rest) + of(i, -1, rest) + s) for i in range(k)]
    return [post(v) for v in votes]


def test_quality_posterior_against_plain_em(spark):
    r = random.Random(11)
    prose = lambda n: " ".join("".join(r.choice("abcdeist") for _ in range(r.randint(2, 8))) for _ in range(n)) + "."
    texts = [prose(r.randint(15, 90)) for _ in range(120)]
    texts += [prose(60).replace(" ", " ### ") for _ in range(15)] + [prose(10) + ("\n" + prose(3)) * 2 for _ in range(10)] + [(prose(12) + "\n") * 6 for _ in range(10)]
    got = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    want = em([r.votes for r in got])
    assert [r.quality for r in got] == pytest.approx(want, abs=1e-6)
    assert [r.kept for r in got] == [not r.base_failed and q >= 0.5 for r, q in zip(got, want, strict=True)]
    assert not any(got[i].kept for i in range(120, 135)) and len({round(r.quality, 3) for r in got}) > 3


def test_a_wrong_rule_is_outvoted(spark):
    """Two rules see a fault; a third goes off on a third of all documents, whatever they are like."""
    r = random.Random(7)
    votes = []
    for _ in range(3000):
        good = r.random() < 0.85
        votes.append([*((1 if good else -1) if r.random() < 0.95 else 0 for _ in range(2)), -1 if r.random() < 0.33 else 1])
    df = spark.createDataFrame([(v,) for v in votes], "votes array<int>")
    params = quality.fit(df, 3)
    alone = {tuple(x.votes): x.p for x in df.distinct().select("votes", quality.posterior("votes", params).alias("p")).collect()}
    assert alone[1, 1, -1] > 0.9 and alone[-1, -1, 1] < 0.1  # not all must pass, and not any vote fails
    assert [alone[tuple(v)] for v in votes[:50]] == pytest.approx(em(votes)[:50], abs=1e-6)


def test_rates_learned_from_votes(spark):
    r = random.Random(7)
    votes = []
    for _ in range(3000):
        good = r.random() < 0.8
        votes.append(([(1 if good else -1) * (1 if r.random() < p else -1) if r.random() < 0.9 else 0 for p in (0.95, 0.9, 0.7)],))
    p = quality.fit(spark.createDataFrame(votes, "votes array<int>"), 3, strength=5.0)
    assert p["prior"] == pytest.approx(0.8, abs=0.08) and p["good"][0] > p["good"][2] and p["bad"][0] > p["bad"][2]


def test_ranks_have_no_gaps(spark):
    df = spark.range(500).selectExpr("id % 3 as k", "id")
    got = defaultdict(list)
    for r in common.ranked(df, ["k"], ["id"], "n", buckets=7).collect():
        got[r.k].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
