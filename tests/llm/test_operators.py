"""The operators against brute force, and on what real tables hold: nulls, empty and long texts, ties, repeated rows, nothing, clashing columns."""

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from streamweave.llm import bpe, common, embedding_dedup, fingerprints, language_id, licenses, mixing, ngram_join, pretokens, quality, sharding, token_counts

WORDS = "the of and river stone house green walks over under quick brown fox jumps lazy dog table chair window garden".split()
LANGS = {"en": "the and of is that with for was this from", "de": "der und die ist nicht mit für war dies von ß ü", "fr": "le et de est que avec pour était ce depuis é è"}


def _prose(r: random.Random, n: int, words=WORDS) -> str:
    return " ".join(r.choice(words) + ("." if r.random() < 0.1 else "") for _ in range(n))


def _rows():
    r = random.Random(7)
    rows = []
    for i in range(60):
        lang = r.choice(list(LANGS))
        rows.append((i, _prose(r, r.randint(3, 120), WORDS + LANGS[lang].split() * 3), lang, f"src{i % 4}"))
    base = _prose(r, 150)
    rows += [(100 + k, base, "en", "src0") for k in range(12)]  # exact copies
    for k in range(12):  # near copies
        w = base.split()
        w[5 + 11 * k] = "changed"
        rows.append((200 + k, " ".join(w), "en", "src0"))
    rows += [
        (300, None, "en", "src1"), (301, "", None, None), (302, "   \n\t ", "de", "src2"), (303, "one", None, "src2"), (304, "One", "en", None), (305, "a b c", "en", "src1"), (306, "12 34 !!", "fr", "src9"),
        (307, _prose(r, 30000), "en", "src3"), (308, "日本語 テキスト é <|endoftext|> x", "fr", "src3"), (308, "日本語 テキスト é <|endoftext|> x", "fr", "src3"), (None, "no id at all here", "en", "src1"),
        (309, "x" * 5000, None, "src1"),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ["node", "n", "key", "bits", "unit", "size", "_bucket", "_key", "component", "block", "task", "a", "b", "u", "v"]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("extra") for c in CLASHING})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(t):
    return (t or "").encode().lower().split()


def _set(t, k):
    w = _words(t)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def _components(rows, k, percent):
    sets = {(i, t): _set(t, k) for i, t, *_ in rows if i is not None}
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    items = list(sets.items())
    for x, ((i, _), s) in enumerate(items):
        for (j, _), t in items[:x]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = top(i), top(j)
                if a != b:
                    up[max(a, b)] = min(a, b)
    return {(i, len(s)): top(i) for (i, _), s in sets.items()}


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 8192), (5, 80, 8192), (4, 85, 3)])
def test_ngram_join_against_all_pairs(docs, rows, width, percent, block):
    got = ngram_join.jaccard_components(docs, width, percent, block).collect()
    assert len(got) == len(rows)
    want = _components(rows, width, percent)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id, r.n_shingles], r


def test_ngram_join_prefixes_with_long_lists(spark):
    """A passage that all documents share makes long lists; links are the same."""
    r = random.Random(1)
    passage = _prose(r, 60)
    rows = [(i, _prose(r, 40) + " " + passage, "en", "s") for i in range(80)] + [(100 + i, passage + f" end{i}", "en", "s") for i in range(30)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85)
    want = _components(rows, 4, 85)
    assert {(x.doc_id, x.n_shingles): x.component_id for x in got.collect()} == want


@pytest.mark.parametrize("most", [8, 1024])
def test_ngram_join_of_lists_in_chunks(spark, most):
    """Documents made of common passages alone make lists that are long in every order; they are dealt as pairs of chunks."""
    r = random.Random(2)
    parts = [_prose(r, 25) for _ in range(6)]
    rows = [(i, " ".join(r.choice(parts) for _ in range(r.randint(1, 4))), "en", "s") for i in range(150)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85, most_of_list=most)
    assert {(x.doc_id, x.n_shingles): x.component_id for x in got.collect()} == _components(rows, 4, 85)


def test_ngram_join_of_nothing(nothing):
    assert ngram_join.jaccard_components(nothing).count() == 0 and ngram_join.dedup(nothing).count() == 0
    with pytest.raises(ValueError):
        ngram_join.jaccard_components(nothing, percent=49)


def test_dedup_goes_by_rows(spark):
    """Rows of one doc_id with different texts each go with their own group; without doc_id they link too; a _stays column is one like others."""
    r = random.Random(5)
    a, b, c = (_prose(r, 40) for _ in range(3))
    rows = [(3, a, 1), (7, a, 2), (7, b, 3), (None, c, 4), (None, c, 5), (None, b, 6), (8, None, 7), (8, "", 8), (8, a, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _stays int").withColumns({"_row": F.lit(1), "node": F.lit(2), "_d": F.lit(3), "m": F.create_map(F.lit("k"), F.lit("v"))})
    out = ngram_join.dedup(docs)
    assert out.columns == docs.columns
    kept = sorted(x._stays for x in out.collect())
    assert kept in ([1, 3, 4, 7, 8], [1, 3, 5, 7, 8])
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(docs, 4, 85).collect())
    assert got[(None, 37, 7)] == 1 and got[(None, 37, None)] == 2 and got[(7, 37, 3)] == 1 and got[(7, 37, 7)] == 1 and got[(8, 0, 8)] == 2


def test_t_occurrence_is_exact_for_any_split():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 300, r.integers(20, 60)).astype(np.uint64)) for _ in range(40)]
    lists = ngram_join.Lists(sets)
    for q in range(40):
        overlap = np.array([len(np.intersect1d(sets[q], s)) for s in sets])
        for need in (3, 8, 15):
            for longest in (None, 0, 2, 7):
                found, count = ngram_join.t_occurrence(lists, q, need, longest)
                want = [d for d in range(40) if d != q and overlap[d] >= need]
                assert [d for d in found.tolist() if d != q] == want
                assert all(c == overlap[d] for d, c in zip(found.tolist(), count.tolist()) if d != q)


def test_dedup_keeps_one_of_each_group_and_all_columns(docs, rows):
    out = ngram_join.dedup(docs, 4, 85)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    comp = {i: c for (i, _), c in _components(rows, 4, 85).items()}
    assert sorted(x for x in ids if x is not None) == sorted(set(comp.values()))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 50)] + [(3, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 50)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _mix_want(rows):
    size = [len(_words(t)) for _, t, *_ in rows]
    per = defaultdict(int)
    for s, (_, _, _, src) in zip(size, rows):
        per[src] += s
    order = sorted(per, key=lambda x: (x is None, (x or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, live = {}, 1.5 * sum(size), set(order)
    while True:
        share = {s: left * w[s] / sum(w[x] for x in live) for s in live}
        over = {s for s in live if share[s] > 2 * per[s]}
        if not over:
            return per, {**target, **share}
        for s in over:
            target[s] = 2.0 * per[s]
            left -= target[s]
        live -= over
        if not live:
            return per, target


def test_mix_meets_its_targets(docs, rows):
    got = mixing.take(docs).collect()
    per, target = _mix_want(rows)
    assert len(got) == len(rows)
    by_source = defaultdict(int)
    source = {}
    for i, _, _, s in rows:
        source.setdefault(i, s)
    for r in got:
        assert r.taken <= 2 * r.size
        s = source[r.doc_id]
        assert r.source_size == per[s] and math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-9)
        by_source[s] += r.taken
    for s, n in by_source.items():
        assert n == math.floor(target[s] + 1e-9) or abs(n - target[s]) < 1
    again = mixing.take(docs.repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mix_rows_hold_the_words_taken(docs):
    took = mixing.take(docs).groupBy().agg(F.sum("taken")).first()[0]
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert sum(len(_words(r.text)) for r in out.select("text").collect()) == took


def test_mix_of_whole_rows(docs, rows):
    text, source = defaultdict(set), {}
    for i, t, _, s in rows:
        text[i].add(t)
        source.setdefault(i, s)
    taken = {}
    for r in mixing.take(docs).collect():
        taken.setdefault((r.doc_id, r.size), []).append(r.taken)
    got = mixing.mix(docs, whole=True).collect()
    assert all(r.text in text[r.doc_id] for r in got)
    copies = Counter((r.doc_id, len(_words(r.text))) for r in got)
    assert copies == Counter({k: sum(-(-n // k[1]) for n in v) for k, v in taken.items() if sum(v)})
    over = Counter()
    for (i, size), v in taken.items():
        over[source[i]] += copies[i, size] * size - sum(v)
    assert all(0 <= over[s] < max(size for (i, size) in taken if source[i] == s) for s in over if s in {source[i] for i, size in taken if size})


@pytest.mark.parametrize("whole", [False, True])
def test_mix_tells_rows_apart_by_which_column_is_null(spark, whole):
    docs = spark.createDataFrame([(1, "one two three four", None, "a"), (1, "one two three four", "a", None)], SCHEMA)
    assert Counter((r.lang, r.source) for r in mixing.mix(docs, whole=whole).collect()) == Counter({(None, "a"): 2, ("a", None): 1})


def test_mix_of_rows_with_maps(spark):
    """A map column is carried along; rows that differ in it alone are two rows."""
    docs = spark.createDataFrame([(1, "a b c", "s", {"k": "v"}), (1, "a b c", "s", {"k": "w"}), (2, "d e", "s", None)], "doc_id long, text string, source string, m map<string,string>")
    got = mixing.mix(docs, whole=True).collect()
    assert {(r.doc_id, None if r.m is None else r.m["k"]) for r in got} == {(1, "v"), (1, "w"), (2, None)}
    assert sum(len(r.text.split()) for r in got) >= 12


def test_mix_deals_rows_of_one_doc_id_by_their_texts(spark):
    docs = spark.createDataFrame([(None, f"word{i} of {i}", "s") for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.take(docs)
    assert rows.agg(F.sum("taken"), F.first("target")).first()[0] == 1800
    key = common.md5_key(F.col("doc_id"), mixing.text_md5(F.col("text")), F.lit("mix"))
    assert docs.select(key.alias("k")).distinct().count() == 400


def test_mix_of_nothing(nothing):
    assert mixing.take(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def _place(x, n, seed=1):
    a = math.ceil(math.sqrt(n))
    b = math.ceil(n / a)

    def f(x, key):
        m = 1 << 31
        x = (x % m * 1103515245 + (key * 12345 + 40503)) % m
        x ^= x >> 15
        x = (x * 1540483477) % m
        return x ^ (x >> 13)

    def once(x):
        left, right = divmod(x, b)
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                left = (left + f(right + i * 7919, seed)) % a
            else:
                right = (right + f(left + i * 7919, seed)) % b
        return left * b + right

    x = once(x)
    while x >= n:
        x = once(x)
    return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 1000])
def test_feistel_is_a_permutation(n):
    assert sorted(_place(i, n) for i in range(n)) == list(range(n))


def test_shards(docs, rows):
    got = sharding.shards(docs).collect()
    n = len(rows)
    assert sorted(r.row_number for r in got) == list(range(n))
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for r in got:
        p = _place(r.row_number, n)
        assert (r.shard, r.slot) == (p % 16, p // 16)
    import zlib

    text = {i: t for i, t, *_ in rows if i is not None}
    for r in got:
        if r.doc_id is not None:
            b = (text[r.doc_id] or "").encode()
            assert r.size == len(b) + 1 and r.text_crc32 == zlib.crc32(b) and r.law == "rows" and r.grown_shard is None
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sharding.shards(docs.repartition(2)).collect()), key=str)


def test_shards_of_nothing(nothing):
    assert sharding.shards(nothing).count() == 0


def test_token_counts_as_the_library(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = token_counts.token_counts(docs, path, public_tokenizers.PATTERN).collect()
    want = Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


HARD = ["aaaaaaa" * 40, "isn't we'll I'm", "  \n\n x\t\t y ", "".join(map(chr, range(1, 0x600))), "½ ² ৩ x\x1c\x85\xa0　y", "<|endoftext|><|endoftext|> a<|endoftext|>", "🙂🙂 é́"]


def test_merging_on_hard_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    m = token_counts.Merger(path, public_tokenizers.PATTERN)
    assert m.counts(*pretokens.flat([*HARD, None, ""])).tolist() == [*[len(t.encode(x, add_special_tokens=False).ids) for x in HARD], 0, 0]


def test_token_counts_of_nothing(nothing):
    assert token_counts.token_counts(nothing, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


def test_pieces_as_the_pattern():
    """The pattern on arrays of characters gives what the regex library does."""
    r = random.Random(3)
    some = "abstmdrevl''''  \n\t\r\x0b\x1c\x1f\x85\u2028\u3000\u00a0 1\u0663\u00bd\u00e9\u00df\u4e2d\U0001f600_.,!-"
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 40))) for _ in range(5000)]
    texts += ["", "'", "'s", "'ll", "'l", "'r", "a'", "a's", " 's", "  's", "'re're", "''s", "x'S", "y'sy 're 'll", *HARD]
    texts += ["".join(chr(r.choice([r.randint(0, 0x3FF), r.randint(0, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(3000)]
    data, off = pretokens.flat(texts)
    plain = pretokens.Splitter(f"(?:{pretokens.PATTERN})")
    assert plain.kinds is None and pretokens.PATTERN == public_tokenizers.PATTERN
    for a, b in zip(pretokens.Splitter(pretokens.PATTERN).spans(data, off), plain.spans(data, off)):
        assert (a == b).all()


def test_memo_turns_generations():
    memo = pretokens.Recent(3)
    made = []

    def make(data, begin, size):
        made.extend(bytes(data[a : a + n]) for a, n in zip(begin, size))
        return np.concatenate([data[a : a + n] for a, n in zip(begin, size)]).astype(np.int32), size

    for words in [["a", "bb", "a"], ["ccc", "dddd", "a", "x" * 300]] * 5:
        data, off = pretokens.flat(words)
        ids, row, count = memo.rows(data, off[:-1], np.diff(off), make)
        assert [bytes(ids[a : a + n].astype(np.uint8)).decode() for a, n in zip(row, count)] == words
    assert made.count(b"a") == 1
    r = random.Random(5)
    table, held = common.Table(np.zeros(0, np.uint64), np.zeros(0, np.int32)), {}
    for _ in range(30):
        new = {r.randrange(1 << 64): r.randrange(1 << 30) for _ in range(r.randint(0, 200))}
        table.put(np.array(list(new), np.uint64), np.array(list(new.values()), np.int32))
        held |= new
    asked = np.array([*held, *(r.randrange(1 << 64) for _ in range(500))], np.uint64)
    assert table.get(asked).tolist() == [held.get(k, -2) for k in asked.tolist()]


@pytest.fixture(scope="module")
def coder():
    return bpe.bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_fingerprints_of_rows_that_share_a_doc_id(spark):
    """A third of the rows has one doc_id, another no doc_id: dealt by their texts too, each row still has its next."""
    r = random.Random(8)
    rows = [(5 if i % 3 == 0 else None if i % 3 == 1 else i, _prose(r, 12) + f" {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = docs.withColumn("t", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_first(), "t").collect()
    want = Counter()
    for row, following in zip(order, [*order[1:], order[0]]):
        new = fingerprints.edited(row.text, following.text)
        want[row.doc_id, len(row.text), hashlib.sha256(new.encode()).hexdigest()] += 1
    assert Counter((x.doc_id, x.n_chars, x.edited_sha256) for x in fingerprints.edits(docs).collect()) == want


def test_bpe_of_nothing(nothing):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.digests(nothing, path, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode_rows(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_pieces_of_any_length(coder):
    """Pieces worked out in step, those worked out alone and the appendable table agree."""
    r = random.Random(9)
    texts = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in [*range(1, 60), 255, 256, 257, 700]] + ["\u4e2d\u6587" * n for n in (1, 40, 43, 200)] + ["=" * n for n in (1, 255, 256, 257, 2000)]
    for t, ids in zip(texts, coder.encode_all(texts)):
        assert ids == coder.encode_scalar(t.encode()) and coder.decode(ids) == t.encode()
    ids, at = coder.encode_flat(*pretokens.flat([*texts, None]))
    back, end = coder.decode_flat(ids)
    assert [bytes(back[a:z]).decode() for a, z in zip(end[at[:-1]], end[at[1:]])] == [*texts, ""]


def test_bpe_as_the_library(docs, rows, coder):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for t in HARD:
        assert coder.encode(t) == lib.encode_ordinary(t) and coder.decode(coder.encode(t)) == t.encode()
    got = bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t, *_ in rows:
        ids = lib.encode_ordinary(t or "")
        want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert Counter(tuple(r) for r in got) == want


def test_bpe_appends_and_edits(coder):
    r = random.Random(5)
    data = bytes(r.choice(b"abcdefgh the ing ") for _ in range(400))
    p = bpe.Prefixes(coder, data[:150]).append(data[150:])
    assert p.last == bpe.Prefixes(coder, data).last
    redone = p.edit(200, 205, b"zz top")
    changed = data[:200] + b"zz top" + data[205:]
    assert bytes(p.data) == changed and p.last == bpe.Prefixes(coder, changed).last and redone < len(changed) - 200 + 7


def test_bpe_rows_round_trip(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.decode_rows(bpe.encode_rows(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert rows.columns == [*docs.columns, "token_ids", "decoded"]
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in rows.select("text", "decoded").collect())


def test_fingerprints_of_documents_and_edits(docs, rows):
    got = fingerprints.edits(docs).collect()
    assert len(got) == len(rows)
    known = sorted([(i, t or "") for i, t, *_ in rows if i is not None and i != 308], key=lambda x: x[0])
    nxt = {known[k][0]: known[k + 1][1] for k in range(len(known) - 1)}
    nxt[known[-1][0]] = next(t for i, t, *_ in rows if i is None)  # after the last the first: nulls lead
    text = dict(known)
    for r in got:
        if r.doc_id is None or r.doc_id == 308 or r.doc_id == 307:
            continue
        t = text[r.doc_id]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[r.doc_id][:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b = (fingerprints.fingerprints([x.encode()])[0] for x in (t, e))
        assert r.fingerprint == fingerprints.written(a) and r.edited_fingerprint == fingerprints.written(b)
        assert r.near_edited == fingerprints.likeness(a, b)
    copies = {r.fingerprint for r in got if r.doc_id is not None and 100 <= r.doc_id < 112}
    assert len(copies) == 1


def test_fingerprints_estimate_the_generalised_jaccard_similarity():
    r = random.Random(11)
    gaps = []
    for _ in range(40):
        a = [r.choice(WORDS) for _ in range(60)]
        b = a[:40] + [r.choice(WORDS) for _ in range(30)]
        x, y = Counter(a), Counter(b)
        true = sum((x & y).values()) / sum((x | y).values())
        f, g = fingerprints.fingerprints([" ".join(a).encode(), " ".join(b).encode()], 512)
        gaps.append(fingerprints.likeness(f, g) - true)
    assert abs(np.mean(gaps)) < 0.015 and np.std(gaps) < 0.04


@pytest.mark.parametrize("n", [1, 2])
def test_fingerprints_of_few_rows(spark, n):
    got = fingerprints.edits(spark.createDataFrame([(5, "a b c d", "en", "s"), (6, None, "en", "s")][:n], SCHEMA)).collect()
    assert len(got) == n
    e = "a b c d"[:4] + ("a b c d"[:3] if n == 1 else "")
    assert got[0].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()


def test_fingerprints_of_nothing(nothing):
    assert fingerprints.edits(nothing).count() == 0


def _lang_docs(spark):
    r = random.Random(2)
    rows = []
    for i in range(300):
        lang = list(LANGS)[i % 3]
        rows.append((i, _prose(r, 40, LANGS[lang].split()), lang, "s"))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 ... 34", "en", "s"), (903, LANGS["fr"] * 2000, None, "s")]
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))


def test_language_id_on_held_out_rows(spark):
    df = _lang_docs(spark)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    truth = {r.doc_id: r.lang for r in df.collect()}
    import zlib

    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        if i < 900:
            assert r.lang_pred == truth[i]
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "fr"]


def test_language_id_learns_nothing_from_held_out_rows(spark):
    df = _lang_docs(spark)
    twisted = df.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, language_id.identify(x).collect())) for x in (df, twisted))
    assert a == b


def test_language_profile_is_the_brute_force_count():
    t = "Ab ab, é! a1b"
    want = Counter()
    for w in ["ab", "ab", "é", "a", "b"]:
        p = f" {w} "
        for k in (1, 2, 3):
            for i in range(len(p) - k + 1):
                g = p[i : i + k]
                if g.strip():
                    want[g] += 1
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    kinds, n = language_id.counted(language_id.ngrams(t))
    assert dict(zip(kinds.tolist(), n.tolist())) == {code(g): c for g, c in want.items()}


def test_language_id_without_labels(spark, nothing):
    df = spark.createDataFrame([(1, "some text", None, "s")], SCHEMA)
    assert language_id.identify(df).first().lang_pred == "und" and language_id.identify(nothing).count() == 0
    assert language_id.keep_known(_lang_docs(spark)).count() == 301


def _quality_docs(spark):
    r = random.Random(4)
    rows = [(i, _prose(r, 60), 1) for i in range(120)]
    for i in range(30):
        w = [r.choice(WORDS) for _ in range(60)]
        rows.append((200 + i, [" ".join(x.upper() + "!!" for x in w), " ".join(x + "%%%" for x in w), " | ".join(w), " ".join(x for x in w[:6] for _ in range(10))][i % 4], 0))
    rows += [(400, None, 0), (401, "", 0), (402, " \n ", 0), (403, "Short.", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumn("score", F.lit("clash"))


def test_quality_finds_the_bad_ones(spark):
    df = _quality_docs(spark)
    got = {r.doc_id: r for r in quality.classify(df).collect()}
    truth = {r.doc_id: r.quality for r in df.collect()}
    assert all(got[i].kept == bool(q) for i, q in truth.items()), [i for i, q in truth.items() if got[i].kept != bool(q)]
    assert got[400].score == 0
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, q in truth.items() if q)


def test_quality_of_nothing(nothing):
    assert quality.classify(nothing).count() == 0


def test_quality_estimates_accuracies():
    """Votes drawn from known accuracies give them back."""
    r = np.random.default_rng(9)
    n = 20000
    truth = r.random(n) < 0.8
    acc = np.array([0.95, 0.9, 0.97, 0.9, 0.93, 0.96, 0.94, 0.98])
    v = np.where((r.random((n, 8)) < acc) == truth[:, None], 1, 2)
    # labellers look for faults: they seldom call a good text bad
    v[truth] = np.where(r.random((truth.sum(), 8)) < 0.003, 2, 1)
    kind, counts = np.unique((v * quality._BASE3).sum(axis=1), return_counts=True)
    p, found = quality.estimate(kind, counts.astype(float))
    want = np.where(truth[:, None], v == 1, v == 2).mean(axis=0)
    assert np.abs(found - want).max() < 0.02
    post = dict(zip(kind.tolist(), p.tolist()))
    assert np.mean([(post[c] > 0.5) == t for c, t in zip((v * quality._BASE3).sum(axis=1).tolist(), truth.tolist())]) > 0.99


def _plain_measures(text):
    """The eight measures of a text, by its definition: bytes, words, loops."""
    b = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", b) if w]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0, [math.nan] * 8
    n = len(words)
    capital, small = sum(65 <= c <= 90 for c in b), sum(97 <= c <= 122 for c in b)
    doubled = sum(x == y and chr(y) in "!?.,;:#$%&*|-_=+~" for x, y in zip(b, b[1:]))
    return n, [
        sum(chr(c) in "#$%&*|{}<>=~^_\\+@[]/`" for c in b) / len(b),
        capital / (capital + small) if capital + small else math.nan,
        min(1, doubled / n),
        sum(i > 0 and low[i] == low[i - 1] for i in range(n)) / n,
        sum(low[i] in low[max(0, i - 3) : i] for i in range(n)) / n,
        1 - sum(chr(w[-1]) in ".!?" for w in words) / n,
        sum(len(w) == 1 for w in words) / n,
        sum(not any(48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in w) for w in words) / n,
    ]


def _plain_scores(texts, known, weights, bias):
    out = []
    for t in texts:
        n, measured = _plain_measures(t)
        if not n:
            out.append((0.0, 0.0))
            continue
        code, linear, b = 0, bias, t.encode()
        for j, (_, good, bad, fewest) in enumerate(quality.LABELLERS):
            v = measured[j]
            if not math.isnan(v) and n >= fewest:
                code += 3**j * (1 if v <= good else 2 if v > bad else 0)
            level = quality._LEVELS - 1 if math.isnan(v) else sum(e < v for e in quality._EDGES)
            linear += weights[quality.BUCKETS + j * quality._LEVELS + level]
        for i in range(len(b) - 2):
            h = (b[i] * 0x9E3779B1 ^ b[i + 1] * 0x85EBCA6B ^ b[i + 2] * 0xC2B2AE35) & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x27D4EB2F & 0xFFFFFFFF
            linear += quality._SCALE * weights[h >> 18] / max(1, len(b) - 2)
        out.append((known.get(code, 0.5), 1 / (1 + math.exp(-max(-50, min(50, linear))))))
    return out


def test_quality_against_a_plain_scorer(spark, docs, rows):
    """Measures, votes and scores of whole texts by loops over bytes and words; expectation-maximisation document by document."""
    texts = [x or "" for _, x, *_ in rows if len(x or "") < 5000] + ["!!", "a", "#### ####", "A B C D E F", "the the the cat. cat", "é é", "x" * 50]
    model = quality.learn(docs)
    buf, off = pretokens.flat(texts)
    words, measured = quality.measures(buf, off)
    for t, n, m in zip(texts, words, measured):
        count, plain = _plain_measures(t)
        assert count == n and np.allclose(m, plain, equal_nan=True), t[:80]
    want = _plain_scores(texts, model.patterns, model.weights, model.bias)
    got = quality.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(got) == len(texts)
    for r in got:
        weak, score = want[r.doc_id]
        assert abs(r.weak_label - weak) < 1e-9 and abs(r.score - score) < 1e-6 and r.kept == (r.score >= 0.5)
    # patterns with counts, and the documents one by one, give the same estimate
    every = quality.votes(words, measured)[words > 0]
    code = (every * quality._BASE3).sum(axis=1)
    kind, count = np.unique(code, return_counts=True)
    by_kind, accuracy = quality.estimate(kind, count.astype(float))
    one_by_one, same = quality.estimate(code, np.ones(len(code)))
    assert np.allclose(accuracy, same) and np.allclose(one_by_one, by_kind[np.searchsorted(kind, code)])


def test_quality_fit_is_bounded(spark):
    r = random.Random(6)
    docs = spark.createDataFrame([(i, _prose(r, 60)) for i in range(400)], "doc_id long, text string")
    few, all_of = quality.learn(docs, features=2000), quality.learn(docs)
    assert few.patterns == all_of.patterns and few.accuracy.tolist() == all_of.accuracy.tolist() and not np.allclose(few.weights, all_of.weights)


def test_license_scan(spark, nothing):
    mit = licenses.TEMPLATES["MIT"]
    changed = licenses.TEMPLATES["ISC"].replace("any purpose", "every purpose")
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nMore.", "en", "s"), (2, "x\n" + mit.replace(" obtaining", "\nobtaining") + "\ny", "en", "s"), (3, changed, "en", "s"),
        (4, "My driving license expired; the copyright of this text is mine.", "en", "s"), (5, None, "en", "s"), (6, "", "en", "s"), (7, "word " * 3000 + "Licensed under CC BY-NC 4.0. " + "word " * 3000, "en", "s"),
        (8, "Licensed under the Apache License, Version 2.0.", "en", "s"), (8, "Licensed under the Apache License, Version 2.0.", "en", "s"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.license) for r in got) == Counter([(1, "MIT notice"), (2, "MIT"), (3, "ISC"), (7, "CC-BY-NC-4.0 notice"), (8, "Apache-2.0 notice"), (8, "Apache-2.0 notice")])
    text = {i: t for i, t, *_ in rows}
    for r in got:
        assert text[r.doc_id][r.begin : r.end] == r.wording
    assert [r.differences for r in got if r.doc_id == 3] == [["replace 'any' -> 'every'"]] and all(not r.differences for r in got if r.doc_id != 3)
    assert licenses.scan(nothing).count() == 0


LICENSE_LINES = {
    "Reserved-rights notice": "All rights reserved.", "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.", "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_license_recall_of_a_plain_search(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = Counter((r.doc_id, r.license, r.begin) for r in licenses.scan(docs).collect())
    want = Counter((i, name, m.start()) for i, t in text.items() for name, line in LICENSE_LINES.items() for m in re.finditer(re.escape(line), t or ""))
    assert {name for _, name, _ in want} == set(LICENSE_LINES) and got == want


@pytest.mark.parametrize("sep", [" ", "\n"])
def test_license_notices_beside_prose(sep):
    scanner, r = licenses.Scanner(licenses.TEMPLATES), random.Random(3)
    for name, line in LICENSE_LINES.items():
        for size in (50, 100, 200, 500, 1000, 2000, 3900, 4100, 5000):
            words = _prose(r, size // 3).split()
            while len(" ".join(words)) > size:
                words.pop()
            for at in (0, len(words) // 2, len(words)):
                for wording in (line, line.upper()):
                    text = sep.join(x for x in (" ".join(words[:at]), wording, " ".join(words[at:])) if x)
                    got = [(f[0], f[3]) for f in scanner.scan(text, 0.9, 0.15)]
                    assert got == [(name, wording)], (size, at)


@pytest.mark.parametrize("sep", [" ", "\n", "\nsome prose stands here between them\n"])
def test_license_notices_that_stand_together(sep):
    scanner = licenses.Scanner(licenses.TEMPLATES)

    def found(wordings):
        return [f[0] for f in sorted(scanner.scan(sep.join(wordings), 0.9, 0.15), key=lambda f: f[1])]

    for names in [*itertools.product(licenses.TEMPLATES, repeat=2), *itertools.permutations(LICENSE_LINES, 4), ["MIT notice"] * 7]:
        assert found([licenses.TEMPLATES[n] for n in names]) == list(names)
    # of two in one block, the second has a word put in
    assert found(["Released under the MIT License.", "Released under the new MIT License."]) == ["MIT notice"] * 2
    assert found(["Licensed under CC BY-NC 4.0.", "Licensed, freely, under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0."]) == ["CC-BY-NC-4.0 notice"] * 3


def test_license_scan_of_rights_and_copyright(spark):
    rows = [
        (1, "A tale.\nCopyright (c) 2024 Jane Doe.", "en", "s"), (2, "ends here\nAll rights\nreserved.", "en", "s"), (3, "Copyright © 2020\nSome rights reserved.", "en", "s"),
        (4, "All of these rights were given, none was reserved; the copyright of part (c) is mine.", "en", "s"), (5, "No rights reserved.", "en", "s"), (6, "All rights are reserved.", "en", "s"),
    ]
    got = Counter((r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter([
        (1, "Copyright notice (c)"), (2, "Reserved-rights notice"), (3, "Copyright notice ©"), (3, "Some-rights notice"), (5, "No-rights notice"), (6, "Reserved-rights notice (are)"),
    ])


PUBLISHED = {
    "GPL-3.0 header": """
    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.""",
    "MPL-2.0 header": """
This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-2.0 header": """
This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-2-Clause": """
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "CC-BY-3.0 full notice": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
}


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// "])
def test_license_texts_as_published(sign):
    """In lines, with comment signs, list marks and prose about them: the license itself and no sibling, word for word."""
    scanner, r = licenses.Scanner(licenses.TEMPLATES), random.Random(4)
    for name, wording in PUBLISHED.items():
        text = "\n".join(sign + line for line in (_prose(r, 30) + "\n" + wording + "\n" + _prose(r, 30)).split("\n"))
        assert [(f[0], f[4], f[6]) for f in scanner.scan(text, 0.9, 0.15)] == [(name, 1.0, [])], name
    # what is nearly one of the templates is another license
    for text in ("This work is licensed under the GNU General Public License, version 4.", "Licensed under CC BY-NC 2.5.", "Released under the MIT No Attribution License.",
                 "This work is licensed under a Creative Commons Attribution-Other 4.0 International License.", "Licensed under the Apache License, Version 1.1."):
        assert not list(scanner.scan(sign + text, 0.9, 0.15)), text
    both = PUBLISHED["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED BY", licenses._BSD_NAMES + "\n\nTHIS SOFTWARE IS PROVIDED BY", 1)
    assert [f[0] for f in scanner.scan(both, 0.9, 0.15)] == ["BSD-3-Clause"]


def test_license_scan_against_every_alignment():
    """Each short template alone: it is found where, and only where, some span of the text agrees with it (longest common subsequence over all spans)."""
    r = random.Random(12)
    checked = 0
    for name, template in licenses.TEMPLATES.items():
        _, t = licenses._words(template)
        if not 4 <= len(t) <= 25:
            continue
        scanner = licenses.Scanner({name: template})
        for _ in range(12):
            words = template.split()
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(words))
                words[at : at + r.randint(0, 1)] = r.choice([[], ["extra"], ["two", "more"], [words[at]]])
                words = words or ["none"]
            text = " ".join(_prose(r, r.randint(0, 25)).split() + words + _prose(r, r.randint(0, 25)).split())
            _, w = licenses._words(text)
            want = False
            for i in range(len(w)):
                row = [0] * (len(t) + 1)
                for j in range(i, min(len(w), i + 2 * len(t))):
                    new = [0]
                    for k in range(len(t)):
                        new.append(row[k] + 1 if w[j] == t[k] else max(row[k + 1], new[k]))
                    row = new
                    must = Counter(x for x in t if licenses._names(x) or licenses._NUMBER.fullmatch(x))
                    there = Counter(w[i : j + 1])
                    want = want or row[-1] / max(len(t), j - i) >= 0.9 and all(there[x] >= n for x, n in must.items()) and not any(licenses._names(x) and x not in must for x in there)
            assert bool(list(scanner.scan(text, 0.9, 0.15))) == want, (name, text)
            checked += want
    assert checked > 50


def test_license_ties_and_clashing_columns(spark):
    same = licenses.Scanner({"first": "Released under the MIT License.", "second": "Released under the MIT License."})
    assert [f[0] for f in same.scan("Released under the MIT License.", 0.9, 0.15)] == ["first"]
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "All rights reserved.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("extra") for c in ("license", "begin", "end", "wording", "differences")})
    assert Counter((r.doc_id, r.license, r.begin) for r in licenses.scan(docs).collect()) == Counter([(1, "MIT notice", 0)] * 2 + [(None, "Reserved-rights notice", 0)])


def _vectors():
    r = np.random.default_rng(6)
    rows = []
    for i in range(150):
        rows.append((i, r.normal(size=8).tolist(), i % 3))
    for k in range(40):  # one cluster, wider than a beam's first width
        rows.append((200 + k, (np.ones(8) + 0.03 * r.normal(size=8)).tolist(), 1))
    rows += [(300 + k, [1.0] * 8, 1) for k in range(10)] + [(320, [2.0] * 8, 1), (321, [1.0] * 8, 2), (322, [1.0] * 8, None)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] + [1.0] * 7, 1), (403, [float("inf")] * 8, 1), (404, [None] + [1.0] * 7, 1), (405, [], 1), (406, [1.0] * 4, 1), (407, [-0.0, 0.0, 1.0] + [0.0] * 5, 0), (408, [0.0, 0.0, 1.0] + [0.0] * 5, 0)]
    return rows


@pytest.mark.parametrize("shard", [8192, 40])
def test_embedding_dedup_against_all_pairs(spark, shard):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).withColumns({"unit": F.lit(1), "v": F.lit(2), "n": F.lit(3)})
    got = {r.vec_id: r for r in embedding_dedup.near_components(df, shard=shard).collect()}
    assert len(got) == len(rows)

    def fit(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links, up = Counter(), {i: i for i, *_ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, v, label in rows:
        for j, w, other in rows:
            if i < j and label == other and label is not None and fit(v) and fit(w) and len(v) == len(w):
                if np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    a, b = top(i), top(j)
                    up[max(a, b)] = min(a, b)
    for i, *_ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], top(i), top(i) == i), i


def test_embedding_dedup_over_several_graphs(spark):
    """3000 units in ten graphs against all pairs; no task holds more than a shard, and no unit is searched for twice in one."""
    r = np.random.default_rng(14)
    centres = r.normal(size=(600, 24))
    x = np.concatenate([c + r.choice([0.02, 0.05, 0.2]) * r.normal(size=(4, 24)) for c in centres] + [centres[0] + 0.02 * r.normal(size=(600, 24))])
    df = spark.createDataFrame([(i, v.tolist(), "hot") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    units = df.select("label", F.col("embedding").alias("v"), F.col("vec_id").alias("unit"), F.lit(1).cast("bigint").alias("copies"))
    for ahead in (2, 32):
        tasks = embedding_dedup.dealt(units, 300, ahead).groupBy("task").agg(F.count_if(F.col("kind") < 2).alias("own"), F.count_if(F.col("kind") == 2).alias("queries")).collect()
        assert max(t.own for t in tasks) <= 360 and max(t.queries for t in tasks) <= min(5, ahead) * 360
        assert sum(t.queries for t in tasks) + 3000 >= 3000 * 9 / 2
    unit = embedding_dedup.unit_rows(x)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    got = {v.vec_id: v for v in embedding_dedup.near_components(df, shard=300, ahead=2).collect()}
    found = sum(v.n_links for v in got.values())
    assert 0.98 * near.sum() <= found <= near.sum()
    assert all(0.9 <= v.recall <= 1.0 and v.n_links <= near[i].sum() for i, v in got.items())
    up = np.arange(len(x))
    common.unite(up, *np.nonzero(near))
    up = common.roots(up)
    assert np.mean([got[i].component_id == up[i] for i in range(len(x))]) >= 0.98


def test_embedding_dedup_of_nothing(spark):
    assert embedding_dedup.near_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_small_world_recall():
    r = np.random.default_rng(8)
    centres = r.normal(size=(60, 32))
    x = embedding_dedup.unit_rows(np.concatenate([c + 0.08 * r.normal(size=(20, 32)) for c in centres]))
    graph = embedding_dedup.SmallWorld(x)
    found = sum(len(rows) for rows, _ in graph.within(x, 0.98, own=True))
    assert graph.truth >= 100 and graph.hit >= 0.9 * graph.truth
    true = int((x @ x.T >= 0.98).sum())
    assert found >= 0.98 * true and found <= true


def test_words_and_shingles_in_chunks():
    import pyarrow as pa

    r = random.Random(3)
    texts = ["a b c d e", "  A  b\tC d\x0be ", "", None, "x", "é ü 日本 b"] + [_prose(r, r.randint(0, 90)) for _ in range(40)]
    old = common.CHUNK
    try:
        common.CHUNK = 200
        buf, off = common.texts(pa.array(texts))
        got = list(common.shingle_sets(buf, off, 3))
    finally:
        common.CHUNK = old
    assert [len(s) for s in got] == [len(_set(t, 3)) for t in texts]
    assert (got[0] == got[1]).all()


def test_checkpoints_go_to_the_shared_folder(spark):
    folder = common.shared_folder(spark)
    assert folder and common.cut(spark.range(3)).count() == 3


def test_base64_of_fingerprints():
    f = fingerprints.fingerprints([b"some words here"])[0]
    assert len(base64.b64decode(fingerprints.written(f))) == 2 * fingerprints.SAMPLES
    assert fingerprints.likeness(None, None) == 1.0 and fingerprints.likeness(None, f) == 0.0
