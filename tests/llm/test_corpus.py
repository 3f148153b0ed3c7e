"""Brute-force versions of the corpus operators, and their edge cases."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from waymeet.llm import decontaminate, exact_dedup, licenses, packing, quality, simhash, token_counts, toxicity, url_filter, warc
from waymeet.llm.queries import QUERIES, SQL, tokenizer_path
from waymeet.llm.words import words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, `row` string, rn int"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("the of and to in near far road bridge signal lamp wheel turn left right stop go".split()) + str(rng.randrange(40)) for _ in range(n)]


def hard_docs():
    """Nulls, empty, white space, very long, repeated rows, ties, clashing columns."""
    base = " ".join(words(120, 1))
    near = " ".join([*words(120, 1)[:-1], "changed"])
    texts = [
        (1, base), (2, base), (3, base.replace(" ", "\n ")), (4, near), (5, None), (6, ""), (7, " \t\n"), (8, "a b"), (9, "A  B"),
        (10, "Ünï çødé \U0001f600 text"), (11, " ".join(words(20_000, 2))), (11, " ".join(words(20_000, 2))), (12, "one"), (13, "one "),
        (None, base), (None, "no id"), (14, "cc by"), (15, "x" * 50_000), (16, " ".join(words(60, 3))), (16, " ".join(words(60, 4))),
    ]
    return [(i, t, None, "src0", None, 0.5, "clash", 7) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_docs(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- exact dedup


def strip(t):
    return "".join(c for c in t or "" if c not in WHITE)


def test_exact_groups_match_brute_force(docs):
    rows = [r.asDict() for r in exact_dedup.exact_groups(docs, window_bytes=2000).collect()]
    given = hard_docs()
    assert len(rows) == len(given)
    groups = {}
    for d in given:
        groups.setdefault(strip(d[1]), []).append(d)
    for body, members in groups.items():
        sha = hashlib.sha256(body.encode()).hexdigest()
        mine = [r for r in rows if r["text_sha256"] == sha]
        best = min(members, key=lambda d: (-len(d[1] or ""), d[0] is None, d[0] or 0))
        assert sorted(str(r["doc_id"]) for r in mine) == sorted(str(d[0]) for d in members)
        assert {r["group_size"] for r in mine} == {len(members)} and {r["keep_id"] for r in mine} == {best[0]}
        assert [r["doc_id"] for r in mine if r["kept"]] == [best[0]]


def test_exact_groups_same_after_subtrees_are_spilled(docs):
    whole = {tuple(r) for r in exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()}
    spilled = {tuple(r) for r in exact_dedup.exact_groups(docs, window_bytes=100, trie_bytes=300).select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()}
    assert whole == spilled


def test_patricia_trie_keeps_strings_apart():
    rng = random.Random(5)
    made = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(600)]
    trie = exact_dedup.PatriciaOwners()
    rank = [(-rng.randrange(3), rng.randrange(50), i, 0) for i in range(len(made))]
    for i, body in enumerate(made):
        assert trie.insert(body, i, 2, rank[i]) == made.index(body)
    found = {body: (o.first, o.n_rows, o.best) for body, o in trie.walk()}
    assert found == {b: (made.index(b), 2 * made.count(b), min(r for r, m in zip(rank, made) if m == b)) for b in set(made)}
    size = trie.held
    for _ in range(1000):
        trie.insert(made[0], 7, 1, rank[0])
    assert trie.held == size


def test_drop_exact_copies_keeps_columns(docs):
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == len({strip(d[1]) for d in hard_docs()})


# ---- SimHash


def slow_fingerprint(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(ids, fps, limit=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= limit:
            root[find(j)] = find(i)
    out = {}
    for i in range(len(ids)):
        out.setdefault(find(i), []).append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in out.values() for i in g}


def test_near_groups_match_brute_force(docs):
    rows = simhash.near_groups(docs).collect()
    given = hard_docs()
    fps = [slow_fingerprint(d[1]) for d in given]
    comp = slow_components([d[0] for d in given], fps)
    want = sorted((str(d[0]), fps[i], str(comp[i])) for i, d in enumerate(given))
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in rows) == want


@pytest.mark.parametrize("prefix_values", [10_000, 1_000_000])
def test_links_of_fingerprints_match_brute_force(spark, prefix_values):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for flips in range(1, 8):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), flips)))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, prefix_values).collect()
    root = list(range(len(fps)))
    at = {f: i for i, f in enumerate(signed)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        root[find(at[r["a"]])] = find(at[r["b"]])
    want = slow_components(list(range(len(fps))), fps)
    smallest = {}
    for i in range(len(fps)):
        smallest[find(i)] = min(smallest.get(find(i), i), i)
    assert {i: smallest[find(i)] for i in range(len(fps))} == want


def test_bucket_is_split_when_its_values_are_many():
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = np.array(sorted({base ^ sum(1 << b for b in rng.sample(range(56), k)) for k in (0, 1, 2, 3) for _ in range(30)}), np.uint64)
    left = np.full(len(fps), 2)
    small = simhash.links_of(fps, left, 56, 4, max_values=20_000)
    large = simhash.links_of(fps, left, 56, 4, max_values=10**9)
    assert set(small[0]) == set(large[0]) and len(small[0]) == len(large[0])


def test_drop_near_copies_keeps_one_of_each_group(docs):
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    given = hard_docs()
    comp = slow_components([d[0] for d in given], [slow_fingerprint(d[1]) for d in given])
    kept = sorted(str(r["doc_id"]) for r in out.select("doc_id").collect())
    assert set(kept) == {str(c) for c in comp.values()}
    assert kept.count("1") == kept.count("5") == kept.count("11") == 1


# ---- packing and token counts


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return made.encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_the_ids_of_the_tokenizers_library(spark, sf):
    encode = packing.bpe_encoder(open(tokenizer_path()).read())
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    odd = ["", " ", "\n\n \t", "don't  stop  ", "a\u00a0b\u2003c", "日本語 テキスト", "\U0001f600\U0001f601", "<|endoftext|>", "x" * 3000, "١٢٣ ½ Ⅻ", "e\u0301\u200d", "\x00\x01"]
    odd += ["a<|endoftext|>b", "hello <|endoftext|> world<|endoftext|>", "  <|endoftext|>  ", "<|endoftext", "\x1c\x1d x"]
    for n in (packing.LONG_RUN - 1, packing.LONG_RUN, 3000):
        odd += [" " * n, "a" + " " * n + "b", "\n " * n + "\u3000" * n, "x " + "\t" * n + " <|endoftext|>" + " " * n, "a\n" * 9 + "\x85" * n + "\x1c" * n + "é"]
    for t in texts + odd:
        assert list(encode(t)) == reference_ids(t), t[:40]


@pytest.mark.parametrize("unit,many", [(" ", 5_000_000), ("\n ", 2_500_000), ("x", 5_000_000), ("ab ", 1_500_000)])
def test_encoder_takes_very_long_texts(unit, many):
    from tokenizers import Tokenizer

    encode = packing.bpe_encoder(open(tokenizer_path()).read())
    ids = encode(unit * many)
    assert len(ids) > 1000 and Tokenizer.from_file(tokenizer_path()).decode(ids[-100:].tolist()) == (unit * many)[-len(Tokenizer.from_file(tokenizer_path()).decode(ids[-100:].tolist())) :]


@pytest.mark.parametrize("window", [2000, 1 << 20])
def test_packing_is_whole_and_gapless(docs, window):
    rows = [r.asDict() for r in packing.pack(docs, tokenizer_path(), window=window).collect()]
    by_seq, by_doc = {}, {}
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and 0 < r["length"] <= 1024
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    for d in hard_docs():
        if sum(x[0] == d[0] for x in hard_docs()) > 1:
            continue
        ids = [*reference_ids(d[1]), 2]
        pieces = sorted(by_doc[d[0]], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert b"".join(r["ids"] for r in pieces) == np.array(ids, "<u4").tobytes()
        assert all(r["length"] == 1024 for r in pieces[1:])
        assert [r["start"] for r in pieces] == list(np.cumsum([0, *(r["length"] for r in pieces[:-1])]))
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // 1024) + 6


def best_trade_left(bins, sizes):
    """Whether any move or exchange, found by trying all, still raises the sum of squared fills."""
    some = lambda items, most: [c for n in range(most + 1) for c in itertools.combinations(items, n)]
    under = [b for b, items in enumerate(bins.items) if items and bins.room[b]]
    for d, t in itertools.permutations(under, 2):
        for out in some(bins.items[d], 2):
            for back in some(bins.items[t], 2):
                if (len(out), len(back)) not in ((1, 0), (1, 1), (1, 2), (2, 1)):
                    continue
                gain = sum(sizes[i] for i in out) - sum(sizes[i] for i in back)
                if 0 < gain <= bins.room[t] and gain > bins.room[t] - bins.room[d]:
                    return True
    return False


def test_local_search_raises_squared_fill_and_empties_bins():
    rng = random.Random(8)
    for low, top, n in ((1, 300, 60), (1, 700, 90), (1, 1023, 90), (342, 512, 60), (200, 400, 60)):
        sizes = [rng.randrange(low, top) for _ in range(n)]
        start = packing.Bins([1024 - s for s in sizes], [[i] for i in range(n)])
        before = sum((1024 - r) ** 2 for r in start.room)
        end = packing.local_search(start, sizes)
        assert sorted(i for b in end.items for i in b) == list(range(n))
        assert all(1024 - r == sum(sizes[i] for i in b) and r >= 0 for r, b in zip(end.room, end.items, strict=True))
        assert sum((1024 - r) ** 2 for r in end.room) > before
        assert sum(map(bool, end.items)) < n
        assert not best_trade_left(end, sizes)


def test_local_search_saves_sequences_that_best_fit_leaves():
    rng = random.Random(5)
    saved = 0
    for _ in range(6):
        sizes = [rng.randrange(180, 420) for _ in range(400)]
        plain = packing.best_fit(sizes, 1024)
        n = len(plain.items)
        saved += n - sum(map(bool, packing.local_search(plain, sizes).items))
    assert saved > 0


def test_token_histogram_and_sums(docs):
    sums = token_counts.suffix_sums(token_counts.histogram(docs, tokenizer_path()))
    lengths = sorted(len(reference_ids(d[1])) for d in hard_docs())
    rows = {r["length"]: r for r in sums.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for n, r in rows.items():
        assert r["documents"] == lengths.count(n) and r["documents_from"] == sum(x >= n for x in lengths)
        assert r["tokens_from"] == sum(x for x in lengths if x >= n) and r["all_tokens"] == sum(lengths)
        assert r["tokens_cut_here"] == sum(min(x, n) for x in lengths)
    for limit in (0, 1, 7, 512, 10**6):
        assert token_counts.tokens_within(sums, limit) == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile(sums, 0.5) == lengths[-(-len(lengths) // 2) - 1]


# ---- decontamination and licenses


def shingles(text, k=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_contained_items_match_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60)))) for i in range(30)] + [(100, None), (101, ""), (102, "..."), (None, " ".join(words(20, 9)))]
    docs = []
    for d in range(80):
        text = [rng.choice(vocab) for _ in range(rng.randrange(0, 400))]
        for _ in range(rng.randrange(3)):
            piece = (items[rng.randrange(30)][1]).split()
            for _ in range(rng.randrange(3)):
                piece[rng.randrange(len(piece))] = "edit"
            at = rng.randrange(len(text) + 1)
            text[at:at] = piece
        docs.append((d, ", ".join(text).upper() if d % 7 == 0 else " ".join(text)))
    docs += [(200, items[3][1]), (200, items[3][1]), (201, None), (None, items[4][1]), (202, items[5][1] + " x" * 60_000)]
    found = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in found.collect()}
    want = {}
    for d, t in docs:
        for i, u in items:
            a, b = shingles(t), shingles(u)
            if b and len(a & b) / len(b) >= 0.8 - 1e-12:
                want[d, i] = (len(b), len(a & b))
    assert got == want


def test_decontamination_keeps_clean_rows(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(words(120, 1)[20:60]))], "item_id long, text string")
    out = decontaminate.drop_contaminated(docs, items)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert not {1, 2, 3, 4} & set(kept) and kept.count(11) == 2 and kept.count(None) == 1
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0
    assert decontaminate.contained_items(none, items).count() == 0


def test_license_scan_counts_places(spark, none):
    texts = ["", None, "CC BY, cc-by. All rights Reserved!", "general public license " * 3, "cc by" * 2, "x " * 30_000 + "cc by", "Released under the nice MIT License.", "licensed under the Apache license version 2.0"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, "cc by")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        places, labels = [], set()
        for label, phrase in licenses.PHRASES:
            p = phrase.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += here
            labels |= {label} if here else set()
        for r in (r for r in got if r["doc_id"] == i):
            assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted(labels)))
            assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    named = {r["doc_id"]: r["labels"] for r in got}
    assert "apache-2.0" in named[7] and "cc-by" in named[5]
    assert licenses.scan(none).count() == 0


def test_only_ascii_capitals_are_lowered(spark):
    texts = ["CC BY \u0130K \u212aB", "\u212a \u212aEY", "\u00c9T\u00c9 A\u00c9"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r[0] for r in df.orderBy("doc_id").select(words_of(F.col("text"))).collect()]
    assert got == [["cc", "by", "\u0130k", "\u212ab"], ["\u212a", "\u212aey"], ["\u00c9t\u00c9", "a\u00c9"]]
    rows = licenses.scan(df, phrases=[("k", "k key")]).collect()
    assert all(r["n_base"] == 0 for r in rows)


def test_license_span_with_an_inserted_word(spark):
    text = "permission is hereby granted free of any charge to any person obtaining a copy of this software and associated documentation files"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == "mit" and row["base_labels"] == "" and 0.7 <= row["score"] < 1


def slow_spans(text):
    """{template: best share} of notices: of every diagonal and those up to SLACK beyond it, the different places reached."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    out = {}
    for i, (label, notice) in enumerate(licenses.NOTICES):
        t = notice.split()
        hits = {(p - q, q) for p in range(len(w) - 2) for q in range(len(t) - 2) if w[p : p + 3] == t[q : q + 3]}
        best = max((len({q for e, q in hits if d <= e <= d + licenses.SLACK}) for d, _ in hits), default=0)
        out[i, label] = best / (len(t) - 2)
    return out


def test_license_spans_reach_different_places_of_their_template(spark):
    rng = random.Random(2)
    texts = ["licensed under the " * 5, "licensed under a " * 4, "licensed under the apache license version 2 0"]
    for _ in range(40):
        words_ = [w for _, t in rng.sample(licenses.NOTICES, 2) for w in t.split()]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words_))
            words_[at : at + rng.randrange(2)] = rng.choice([[], ["x"], ["x", "y"], words_[:3]])
        texts.append(" ".join(words_))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert not got[0]["labels"] and not got[1]["labels"] and got[2]["labels"] == "apache-2.0"
    for i, text in enumerate(texts):
        spans = slow_spans(text)
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == base | {label for (_, label), share in spans.items() if share >= licenses.COVERAGE}
        assert got[i]["score"] == pytest.approx(1 if base else max(spans.values()))


# ---- URL filters


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"), ("com", "/", "allow"), ("com", "/de", "block")]


def test_url_rules_match_brute_force(spark):
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "xexample.net", "example.com", "EXAMPLE.Com", "org", "", "net:80", "..net", "é.net", "foo.net\x01", "a\x01.net", "net\x01x", "a\x00.net", "a\x02.net", "\U0010ffff.net", "\U0010ffff.a.example.net"]
    paths = ["", "/", "/en/", "/en/x", "/en/xy?q=/de", "/de#f", "/De", "?/en/", "/a b\n"]
    urls = [f"{s}://{h}{p}" for s in ("http", "ftp") for h in hosts for p in paths] + [None, "", "no scheme/net", "a://b://net/en/"]
    pages = [(i, u, "x", "clash") for i, u in enumerate(urls)] + [(1, urls[1], None, None), (None, urls[2], None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, verdict string").repartition(3)
    got = url_filter.judge(df, spark.createDataFrame(RULES, "host string, path string, verdict string"), range_rows=20).collect()

    def slow(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    assert sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got))) == sorted(str((p[0], *slow(p[1]))) for p in pages)
    long_ = [(i, f"http://{h}/en/{'x' * 300_000}{i % 2}", None, None) for i, h in enumerate(["a." * 40_000 + "example.net", "org", "org", "com"])] + [(None, "http://net/", None, None)] * 60
    rows = url_filter.judge(spark.createDataFrame(long_, "page_id long, url string, rule string, key string"), spark.createDataFrame(RULES, "host string, path string, verdict string"), range_rows=7).collect()
    assert sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows))) == sorted(str((p[0], *slow(p[1]))) for p in long_)
    assert url_filter.judge(df.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


# ---- WARC


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://h/{i}", "same" if i % 3 == 0 else f"<p>{i}\r\n\r\né</p>") for i in range(40)]
    pages += [(100, None, None), (101, "http://a b\r\nX: y", ""), (102, "u", "long " * 40_000), (39, "http://h/39", "same"), (None, "n", "same"), (7, "v", "other")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    df = df.withColumns({"check": F.lit("clash"), "is_page": F.lit(1), "refers_to": F.lit("x"), "digest": F.lit(None)})
    folder = f"file://{tmp_path}/a"
    listed = warc.write(df, folder, shards=4, roll_bytes=2000).collect()
    assert sum(r["records"] for r in listed) == len(pages) and len(listed) > 4
    for r in listed:
        data = (tmp_path / "a" / r["name"]).read_bytes()
        assert len(data) == r["bytes"] and hashlib.sha256(data).hexdigest() == r["sha256"] and gzip.decompress(data).count(b"WARC/1.1\r\n") == r["records"]
    assert not (tmp_path / "a" / warc.TEMPORARY).exists()
    (tmp_path / "a" / "pages-00000-99999.warc.gz").write_bytes(b"left by a task that lost")
    rows = warc.read(spark, folder).collect()
    assert len(rows) == len(pages)
    for page_id, _, html in pages:
        raw = (html or "").encode()
        last = max(p[0] for p in pages if p[0] is not None and (p[2] or "") == (html or ""))
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        mine = [r for r in rows if r["page_id"] == page_id and r["payload_digest"] == digest]
        assert mine and all(r["payload_bytes"] == len(raw) for r in mine)
        for r in mine:
            revisit = page_id is not None and page_id < last
            assert (r["record_type"], r["refers_to"]) == (("revisit", last) if revisit else ("response", None))
            assert bytes(r["payload"]) == raw if not revisit else r["payload"] is None
    again = f"file://{tmp_path}/b"
    assert sorted(map(tuple, warc.write(df, again, shards=4, roll_bytes=2000).collect())) == sorted(map(tuple, listed))


def test_warc_size_limit_and_no_pages(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}/c", min_revisit_bytes=5)
    assert sorted((r["page_id"], r["record_type"]) for r in warc.read(spark, f"file://{tmp_path}/c").collect()) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]
    warc.write(df.limit(0), f"file://{tmp_path}/d")
    assert warc.read(spark, f"file://{tmp_path}/d").count() == 0


# ---- classifiers


def labelled(n, column):
    rng = random.Random(1)
    vocab = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ar", "el", "in", "os", "ut")]
    out = []
    for i in range(n):
        good = rng.random() < 0.6
        text = [rng.choice(vocab) for _ in range(rng.randrange(30, 120))]
        if column == "quality" and not good:
            text = [w.upper() + "!!" for w in text]
        if column == "toxic" and good:
            text[5:5] = [rng.choice(["vilewort", "vileling", "foulword"])]
        out.append((i, " ".join(text), int(good)))
    return out


@pytest.mark.parametrize("module,column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, docs, none, module, column):
    rows = labelled(400, column)
    corpus = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], f"doc_id long, {column} int")
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0
    model = module.fit(corpus, labels, usable)
    got = {r["doc_id"]: r["score"] for r in module.score(corpus, model).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 0]
    assert sum((s >= 0.3) == bool(y) for s, y in held) / len(held) > 0.95
    scores = module.score(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert module.score(none, model).count() == 0
    flat = module.fit(docs, labels.limit(0), usable)
    assert {round(r["score"], 6) for r in module.score(docs, flat).collect()} == {0.5}
    again = module.fit(corpus, labels, usable)
    assert {r["doc_id"]: r["score"] for r in module.score(corpus, again).collect()} == got


def test_rejected_rows_go_with_all_columns_kept(spark, docs):
    rows = labelled(300, "quality")
    corpus = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit(corpus, labels, F.lit(True))
    kept = {r["doc_id"] for r in quality.drop_rejected(corpus, model).collect()}
    scores = {r["doc_id"]: r["score"] for r in quality.score(corpus, model).collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.3}
    assert quality.drop_rejected(docs, model).columns == docs.columns


# ---- empty tables, registered queries, the pipeline


def test_empty_tables(spark, none, sf):
    assert exact_dedup.exact_groups(none).count() == 0
    assert simhash.near_groups(none).count() == 0
    assert packing.pack(none, tokenizer_path()).count() == 0
    assert token_counts.suffix_sums(token_counts.histogram(none, tokenizer_path())).count() == 0
    model = quality.fit(none, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    for out in (exact_dedup.drop_exact_copies(none), simhash.drop_near_copies(none), quality.drop_rejected(none, model), decontaminate.drop_contaminated(none, items)):
        assert out.count() == 0 and out.columns == none.columns


def test_pipeline_on_no_documents_and_on_repeated_rows(spark, sf, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
    some = docs.limit(30)
    once = exact_dedup.drop_exact_copies(some).count()
    assert exact_dedup.drop_exact_copies(some.union(some).union(some)).count() == once


def test_clashing_columns_change_no_token_sums(spark, docs):
    clash = docs.withColumns({c: F.lit("clash") for c in ("length", "documents", "tokens", "block")})
    rows = lambda df: sorted(map(tuple, token_counts.suffix_sums(token_counts.histogram(df, tokenizer_path())).collect()))
    assert rows(clash) == rows(docs)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_agree_with_sql(spark, sf, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want, got = con.sql(SQL[name]).df(), QUERIES[name](spark, sf).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return round(float(v), 9) + 0.0 if isinstance(v, (int, float, np.number)) else v

    text = lambda df: sorted(str(tuple(map(plain, r))) for r in df[cols].itertuples(index=False))
    assert text(got) == text(want)


def test_pipeline_matches_its_stages_by_brute_force(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("row", F.lit("clash"))
    seen = {0: docs}
    for k, (_, stage) in enumerate(p.STAGES):
        seen[k + 1] = stage(spark, seen[k], sf).cache()
        if k < 4:
            assert seen[k + 1].columns == docs.columns
    texts = {k: {r["doc_id"]: r["text"] for r in seen[k].select("doc_id", "text").collect()} for k in range(5)}
    groups = {}
    for i, t in texts[1].items():
        groups.setdefault(strip(t), []).append((-len(t), i))
    assert set(texts[2]) == {min(g)[1] for g in groups.values()}
    ids = sorted(texts[2])
    comp = slow_components(ids, [slow_fingerprint(texts[2][i]) for i in ids])
    assert set(texts[3]) == set(comp.values())
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, t in texts[3].items() if not any(b and len(shingles(t) & b) / len(b) >= 0.8 for b in items)}
    assert set(texts[4]) == clean and len(clean) < len(texts[3])
    lengths = {i: len(reference_ids(t)) + 1 for i, t in texts[4].items()}
    packed = seen[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == lengths
    scored = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    assert set(texts[1]) == {r["doc_id"] for r in scored.filter("score >= 0.3").collect()}


# ---- many copies and sizes


def test_tasks_are_bounded_until_they_would_be_too_large():
    from waymeet.llm.common import LARGE_TASK, MANY_TASKS, tasks_for

    assert tasks_for(0, 10) == 1 and tasks_for(101, 10) == 11
    assert tasks_for(10**15, 16 << 20) == -(-(10**15) // LARGE_TASK) > MANY_TASKS
    assert tasks_for(2 * 10**12, 16 << 20) == MANY_TASKS


def test_many_equal_rows_come_back_each(spark, monkeypatch):
    monkeypatch.setattr(licenses, "SLICE", 7)
    rows = [(None, "")] * 100 + [(1, "this is cc by licensed")] * 15 + [(2, "x")] * 7 + [(2, "x y")] * 8
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    count = lambda i: sum(r["doc_id"] == i for r in got)
    assert (count(None), count(1), count(2)) == (100, 15, 15) and all(r["n_base"] == (r["doc_id"] == 1) for r in got)


def test_which_equal_row_stays_does_not_depend_on_the_deal(spark):
    rows = [(i % 5, "same words " * 3, "x" * (i % 7), i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    one, many = (sorted(map(tuple, exact_dedup.drop_exact_copies(df.repartition(n, "n")).collect())) for n in (1, 6))
    assert one == many and len(one) == 1


def test_folding_counts_what_texts_take(spark):
    rows = [(i, f"t{i % 300}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    few, many = (exact_dedup.exact_groups(df, window_bytes=w) for w in (1 << 30, 40_000))
    pick = lambda d: sorted(map(tuple, d.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    assert pick(few) == pick(many)


def test_pages_without_ids_are_dealt_to_several_tasks(spark, tmp_path):
    rows = [(None, f"u{i}", f"body {i % 40}") for i in range(400)] + [(i, "u", "body 3") for i in range(5)]
    folder = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, shards=6)
    got = warc.read(spark, folder).collect()
    assert sorted((r["page_id"] is not None, r["url"], bytes(r["payload"]).decode()) for r in got if r["record_type"] == "response" and r["page_id"] is None) == sorted((False, u, h) for i, u, h in rows if i is None)
    assert {(r["page_id"], r["refers_to"]) for r in got if r["page_id"] is not None} == {(0, 4), (1, 4), (2, 4), (3, 4), (4, None)}
    assert warc.manifest(spark, folder).count() >= 3
