"""The operators against plain versions, over the smallest tables and odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import regex

from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, slot int, text_hash long, at long, rid int, doc long, root long, set_id long, label long, n_words long, kept boolean, items string, part int, before long, rank long, score double"


def base_text(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    a, b = base_text(1), base_text(2)
    edited = a.split()
    edited[60] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "One TWO"), (7, "x" * 5000), (8, "word " * 4000), (10, a), (11, a), (12, " ".join(edited)), (13, b + "\n" + a), (14, "ÀÉ " + b.upper()),
        (15, "#$% " * 60), (16, "line one here\n" * 30), (17, base_text(3, 9000)), (18, base_text(3, 9000) + " end"), (19, "123 456"),
    ]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    full = [(d, t, None if d % 4 == 0 else "en", None if d % 5 == 0 else f"s{d % 3}", len(t or ""), *[None] * 17) for d, t in odd_rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def repeated(df):
    """The rows and, again, some of them; and rows without an id."""
    from pyspark.sql import functions as F

    return df.unionByName(df.filter("doc_id in (3, 10, 12)")).unionByName(df.filter("doc_id in (2, 13)").withColumn("doc_id", F.lit(None).cast("long")))


# -- words and quality


def test_quality_counts(docs, rows, odd, odd_rows):
    from tessera.llm.quality import judge

    for df, want in ((docs, rows), (odd, odd_rows)):
        labels = df.selectExpr("doc_id", "1 as quality", "0 as toxic")
        got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judge(df, labels).collect()}
        assert got == {d: brute.quality(t) for d, t in want}


def test_quality_keeps_what_no_rule_is_certified_for(odd, empty):
    from tessera.llm.quality import judge

    got = judge(odd, empty.selectExpr("doc_id", "1 as quality", "0 as toxic")).collect()
    assert all(r.kept == (not r.base_failed) for r in got)
    assert judge(empty, empty.selectExpr("doc_id", "1 as quality")).count() == 0
    assert judge(repeated(odd), odd.selectExpr("doc_id", "cast(null as int) as quality")).count() == repeated(odd).count()


def test_binomial_bound():
    from tessera.llm.quality import binomial_cdf, certified

    want = sum(math.comb(50, i) * 0.1**i * 0.9 ** (50 - i) for i in range(4))
    assert abs(binomial_cdf(3, 50, 0.1) - want) < 1e-12
    assert not certified(0, 10, 0.01, 0.05) and certified(0, 300, 0.01, 0.05) and not certified(0, 0, 0.01, 0.05)


def test_certified_cutoffs_reject_few_good_documents(spark):
    """With many labels, the share of good documents rejected by the rules stays within the limit; copies of one text
    certify nothing; many strata are no difficulty."""
    from pyspark.sql import functions as F

    from tessera.llm.quality import COUNTS, fit_cutoffs, with_verdict

    n = 20_000
    r = np.random.default_rng(0)
    symbols = np.where(np.arange(n) % 10 == 0, 300, r.integers(0, 4, n))
    table = [(i, "en", i, 100, 600, int(s), 0, 0, 5, 10, 500) for i, s in enumerate(symbols)]
    counts = spark.createDataFrame(table, "doc_id long, stratum string, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS))
    labels = counts.select("doc_id", F.when(F.col("n_symbols") == 300, 0).otherwise(1).alias("quality"))
    cuts = fit_cutoffs(counts, labels)
    kept = with_verdict(counts, cuts).groupBy(F.col("n_symbols") == 300).agg(F.avg(F.col("passes").cast("int"))).collect()
    share = {bool(x[0]): x[1] for x in kept}
    assert share[True] == 0.0 and share[False] > 0.95
    assert fit_cutoffs(counts.withColumn("text_hash", F.col("n_symbols")), labels) == {}
    many = {f"s{i}": cuts["en"] for i in range(3000)} | {None: cuts["en"]}
    assert with_verdict(counts.withColumn("stratum", F.lit(None).cast("string")), many).filter("not passes").count() == int((symbols == 300).sum())


def test_quality_keeps_columns(odd):
    from tessera.llm.quality import judge

    labels = odd.selectExpr("doc_id", "1 as quality")
    got = judge(odd, labels, keep=odd.columns)
    more = [c for c in odd.columns if c not in ("doc_id", "n_words", "kept")]
    assert got.columns[-len(more) :] == more
    want = {r.doc_id: (r.text, r.lang, r.source) for r in odd.collect()}
    assert {r.doc_id: (r.text, r.lang, r.source) for r in got.collect()} == want


# -- repeats


@pytest.mark.parametrize("most_blocks", [1000, 1])
def test_passages(docs, rows, odd, odd_rows, most_blocks):
    from tessera.llm.fm_dedup import drop_passages

    for df, want in ((docs, rows), (odd, odd_rows)):
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in drop_passages(df, most_blocks=most_blocks, bucket_units=5000).collect())
        assert got == brute.passages(want)


@pytest.mark.parametrize("most_blocks", [1000, 1])
def test_substrings(docs, rows, odd, odd_rows, most_blocks):
    from tessera.llm.suffix_dedup import drop_repeats

    for df, want in ((docs, rows), (odd, odd_rows)):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in drop_repeats(df, most_blocks=most_blocks, bucket_units=30_000).collect())
        assert got == brute.substrings(want)


def test_passages_that_differ_in_the_middle(spark):
    """One anchor recurs along the whole text, and copies differ in a word that lies in neither end of its blocks."""
    from tessera.llm.fm_dedup import drop_passages

    line = base_text(11, 20).split()
    rows = [(1, " ".join(line * 20))]
    for i in range(12):
        w = line * 20
        w[70] = f"other{i}"
        rows.append((2 + i, " ".join(w)))
    got = drop_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute.passages(rows)


def test_repeats_of_odd_tables(odd, empty):
    from tessera.llm.fm_dedup import drop_passages
    from tessera.llm.suffix_dedup import drop_repeats

    for f in (drop_passages, drop_repeats):
        assert f(empty).count() == 0
        once = {(r.doc_id, r.kept_sha256) for r in f(odd).collect()}
        for most in (1000, 1):
            got = f(repeated(odd), keep=["size", "at"], with_text=True, most_blocks=most).collect()
            assert len(got) == repeated(odd).count() and once >= {(r.doc_id, r.kept_sha256) for r in got if r.doc_id in (3, 12)}
    got = {r.doc_id: r for r in drop_repeats(odd, with_text=True).collect()}
    assert hashlib.sha256(bytes(got[13].kept)).hexdigest() == got[13].kept_sha256


def test_previous_factors():
    from tessera.llm.suffix_dedup import previous_factors

    r = np.random.default_rng(0)
    for _ in range(20):
        n, depth = int(r.integers(110, 300)), int(r.integers(4, 20))
        ends = np.concatenate([[0], np.sort(r.integers(0, n, 3)), [n]])
        text = r.integers(0, 2, n).astype(np.uint8)
        place, lpf, source = previous_factors(text, ends, depth)
        assert list(place) == [i for a, b in zip(ends[:-1], ends[1:]) for i in range(a, b - depth + 1)]
        part = [bytes(text[i : i + depth]) for i in place]

        def common(a, b):
            return next((k for k in range(depth) if a[k] != b[k]), depth)

        for i in range(len(place)):
            assert lpf[i] == max((common(part[i], part[j]) for j in range(i)), default=0)
            assert (source[i] >= 0) == (lpf[i] > 0) and (source[i] < 0 or common(part[i], bytes(text[source[i] : source[i] + depth])) == lpf[i])


def test_op7_goes_through_previous_factors(monkeypatch):
    from tessera.llm import suffix_dedup

    seen = []
    monkeypatch.setattr(suffix_dedup, "previous_factors", lambda *a: seen.append(a[2]) or (np.array([1]), np.array([3]), np.array([0])))
    flags = suffix_dedup.resolver(3)(np.frombuffer(b"aaaaa", np.uint8), np.array([0, 5]), np.array([1]), np.array([0]))
    assert seen == [3] and list(flags) == [False, True, False, False, False]


def test_matching_statistics():
    from tessera.llm.fm_dedup import FMIndex, least_in

    r = np.random.default_rng(0)
    for depth in (1, 2, 3, 5, 8, 40):
        for _ in range(6):
            held = [r.integers(1, 4, r.integers(0, 30)) for _ in range(6)]
            index = FMIndex(np.concatenate([np.append(s, 0) for s in held]).astype(np.int64), 4, depth)
            asked = [r.integers(1, 4, r.integers(0, 40)) for _ in range(6)]
            asked[0] = np.where(r.random(len(asked[0])) < 0.1, -1, asked[0])
            ends = np.concatenate([[0], np.cumsum([len(q) for q in asked])])
            length, lo, hi = index.matching_statistics(np.concatenate(asked).astype(np.int64), ends)
            texts = [bytes(s.astype(np.uint8)) for s in held]
            for k, q in enumerate(asked):
                for p in range(len(q)):
                    n = 0
                    while p + n < len(q) and n < depth and q[p + n] > 0 and any(bytes(q[p : p + n + 1].astype(np.uint8)) in s for s in texts):
                        n += 1
                    at = ends[k] + p
                    assert length[at] == n
                    if n == depth:
                        want = [i for i, s in enumerate(texts) for j in range(len(s)) if s[j : j + n] == bytes(q[p : p + n].astype(np.uint8))]
                        assert sorted(index.sequence[lo[at] : hi[at]]) == want
            whole = length == depth
            assert list(least_in(index.sequence, lo[whole], hi[whole])) == [index.sequence[a:b].min() for a, b in zip(lo[whole], hi[whole], strict=True)]


# -- near copies


@pytest.mark.parametrize("chunk", [2048, 3])
def test_jaccard_components(docs, rows, odd, odd_rows, chunk):
    from tessera.llm.ngram_join import join

    for df, want in ((docs, rows), (odd, odd_rows)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in join(df, chunk=chunk).collect())
        assert got == brute.jaccard_components(want)


def near_copies(n, seed=0):
    r, base = random.Random(seed), base_text(7, 150).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = f"w{r.randrange(10**9)}"
        out.append((i, " ".join(w)))
    return out


def test_large_group_of_near_copies(spark):
    from tessera.llm.ngram_join import join

    rows = near_copies(400)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in join(df, chunk=64).collect()) == brute.jaccard_components(rows)


def test_hot_signatures_are_given_out_on_the_way(spark, monkeypatch):
    """With tiny buckets and packs, the groups are those of a plain count."""
    from tessera.llm import ngram_join

    like, rows = ngram_join.Likeness(80), near_copies(60, 3) + [(100 + i, base_text(i, 30)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def groups(limit, pack):
        monkeypatch.setattr(ngram_join, "PACK", pack)
        monkeypatch.setattr(ngram_join, "BUCKET_ROWS", limit)
        found = collections.defaultdict(set)
        for r in ngram_join.shared_groups(ngram_join.signature_parts(docs, 5, like, 3), 2).collect():
            found[r.sig].add(r.set_id)
        return {frozenset(v) for v in found.values()}

    import pyarrow as pa

    sets, ends = ngram_join.shingle_sets(pa.array([t for _, t in rows]), 5)
    at, bands = ngram_join.signers(like, np.diff(ends))
    sig, of = ngram_join.signatures(like, sets, ends, at, bands)
    want = collections.defaultdict(set)
    for x, i in zip(sig.tolist(), ngram_join.set_ids(sets, ends)[at][of].tolist(), strict=True):
        want[x].add(i)
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    assert groups(1 << 20, 256) == want
    some = groups(50, 7)
    assert want <= some and all(any(g <= w for w in want) for g in some)


def test_stage_joins_on_five_words(spark):
    """Two spread edits in 100 words: 86/106 on five words, 92/104 on three."""
    import corpus_pipeline

    words = [f"u{i}" for i in range(100)]
    edited = [f"new{i}" if i in (30, 70) else w for i, w in enumerate(words)]
    rows = [*near_copies(40), (100, " ".join(words)), (101, " ".join(edited)), (102, "one two"), (103, "One TWO"), (104, "a b c d e f"), (105, "a b c d e f g")]
    root = {d: c for d, _, c in brute.jaccard_components(rows, 5, 80)}
    got = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    kept = {r.doc_id for r in got.collect()}
    assert kept == set(root.values()) and 100 in kept and 101 not in kept


def test_join_of_odd_tables(odd, empty):
    from tessera.llm.ngram_join import join

    assert join(empty).count() == 0
    got = join(repeated(odd)).collect()
    assert len(got) == repeated(odd).count() and {r.component_id for r in got if r.doc_id == 11} == {10}


def test_components(spark):
    from tessera.llm.common import Work
    from tessera.llm.components import components

    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(Work(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


# -- benchmark items


def test_containment(spark, tiny, docs, rows):
    from tessera.llm.decontaminate import clean, contaminated

    extra = [(900, "The and"), (901, "the"), (902, ""), (903, None), (904, "one two three four"), (905, rows[3][1]), (906, " ".join(rows[5][1].split()[:60]) + " new words here")]
    items = spark.read.parquet(f"{tiny}/benchmark.parquet").unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    want = brute.contained(rows, [(r.item_id, r.text) for r in items.collect()])
    for most in (None, {"index": 0, "shingles": 0}):  # by constants, and by joins
        got = sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in contaminated(docs, items, most=most).collect())
        assert got == want
    assert sorted(r.doc_id for r in clean(docs, items).collect()) == sorted({d for d, _ in rows} - {d for d, *_ in want})


def test_containment_of_odd_tables(spark, odd, empty):
    from pyspark.sql import functions as F

    from tessera.llm.decontaminate import clean, contaminated

    bench = odd.selectExpr("doc_id as item_id", "text")
    assert clean(odd, bench.limit(0)).count() == odd.count() and clean(odd, bench.limit(0)).columns == odd.columns
    names = ("_text", "_h", "_key", "_items", "doc", "items", "k1", "k2", "hits", "found", "own", "uid", "s", "h", "a.b")
    clashing = odd.select("doc_id", "text", *[F.lit(1).alias(c) for c in names])
    for most in (None, {"index": 0, "shingles": 0}):
        assert contaminated(empty, bench, most=most).count() == 0
        got = contaminated(repeated(odd), bench.unionByName(bench.limit(12).withColumn("item_id", F.lit(None).cast("long"))), most=most).collect()
        pairs = [(r.doc_id, r.item_id) for r in got]
        assert (13, 10) in pairs and (None, 10) in pairs and (13, None) in pairs and pairs.count((12, 12)) == 2
        left = clean(clashing, bench.filter("item_id = 10"), most=most)
        assert left.columns == clashing.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in odd.collect()} - {10, 11, 12, 13}


def test_benchmark_of_many_sizes(spark):
    from tessera.llm.decontaminate import contaminated

    items = [(n, " ".join(f"w{n}x{j}" for j in range(n))) for n in range(1, 1500, 3)]
    docs = [(n, f"before it {t} and after") for n, t in items if n % 50 == 1] + [(5000, " ".join(f"w100x{j}" for j in range(0, 100, 2)))]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(n, n) for n, _ in docs if n < 5000]


# -- surrogates


def test_surrogates(spark, odd, empty):
    from tessera.llm.pii import replace

    texts = [
        (1, "Mail Bob.Smith1@Mail.example.com or BOB.SMITH1@MAIL.EXAMPLE.COM, 10.0.0.1 and 192.168.3.77."), (2, "card 4111 1111 1111 1111 or 4111111111111111; Mrs Anna Smith, Herr Müller, г-жа Анна Иванова"),
        (3, 'token = "c9c8b45435718dcc700c184a7e303cdc64c6a8f7" +1 (132) 555-1352 123-45-6789 password: hunter2hunter2'), (4, "nothing here: 12 or 1999"), (5, None), (6, ""), (7, "bob.smith1@mail.example.com"),
    ]
    got = {r.doc_id: r for r in replace(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"]).collect()}
    for secret in ("smith1@", "10.0.0.1", "192.168.3.77", "4111", "Anna Smith", "Müller", "Иванова", "c9c8b454", "555-1352", "123-45-6789", "hunter2"):
        assert all(secret.lower() not in (r.text or "").lower() for r in got.values())
    assert got[4].text == texts[3][1] and got[5].text is None and got[6].text == "" and got[5].n_entities == 0
    first, second = got[1].text.split()[1], got[1].text.split()[3].rstrip(",")
    assert first.lower() == second.lower() == got[7].text.lower() and second.isupper()
    cards = got[2].text.split("card ")[1].split(" or ")
    assert cards[0].replace(" ", "") == cards[1].split(";")[0]
    digits = [int(c) for c in cards[1].split(";")[0]][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert got[2].kinds[2:] == ["woman", "man", "woman"] and got[2].n_entities == 5
    assert replace(empty, ["doc_id"]).count() == 0 and replace(repeated(odd), ["doc_id", "lang", "text"]).count() == repeated(odd).count()


def replaced(spark, texts, **options):
    from tessera.llm.pii import replace

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(replace(df, ["doc_id"], **options).collect(), key=lambda r: r.doc_id)]


def test_names(spark):
    texts = [
        "then Mr McDonald and Herr Müller-Lüdenscheidt and Mrs O'Brien's house", "Mr Smith met Mrs Smith", "here Mr Smith", "Mr John Smith came. Mr Smith left. John Smith slept, Smith-like, Smithson.", "Mrs ANNA J. SMITH and Smith",
        "г-жа Анна Иванова и г-н Иванов", "Herr von der Leyen, Señora María-José García", "Mr\u00a0Brown and Mr\nGreen and Mr  White",
    ]
    got = [r.text for r in replaced(spark, texts)]
    for clear in ("McDonald", "Donald", "Müller", "Lüdenscheidt", "Brien", "Smith ", "John", "ANNA", "SMITH", "Анна", "Иванов", "Leyen", "María", "José", "García", "Brown", "Green", "White"):
        assert not any(clear in t for t in got), clear
    smith = got[2].split()[2]
    assert got[1] == f"Mr {smith} met Mrs {smith}" and got[0].split("'")[-1] == "s house" and got[0].split()[8].startswith("O'")
    john = got[3].split()[1]
    assert got[3] == f"Mr {john} {smith} came. Mr {smith} left. {john} {smith} slept, {smith}-like, Smithson."
    assert got[4].split()[3] == smith.upper() and got[4].split()[1].isupper() and got[4].split()[1].endswith("NA") and got[4].split()[2][1] == "."
    anna, ivanova, ivanov = got[5].split()[1], got[5].split()[2], got[5].split()[5]
    assert ivanova == ivanov + "а" and anna.endswith("на") and got[6].startswith("Herr von der ")


def test_types_and_forms(spark):
    got = replaced(spark, ["+49 30 1234567 or +49301234567 or +49-30-1234567", "password=Sunshine", "token: 123-45-6789", "DE89 3704 0044 0532 0130 00", "password=Sunshine and password=sunshine", "GR bob.ωμέγα@x.org"])
    phones = got[0].text.split(" or ")
    assert len({p.replace(" ", "").replace("-", "") for p in phones}) == 1 and phones[0].startswith("+49 ") and phones[2][3] == "-" and "1234567" not in got[0].text
    assert list(got[1].kinds) == list(got[2].kinds) == ["secret"] and "Sunshine" not in got[1].text
    iban = got[3].text
    turned = "".join(str(int(c, 36)) for c in iban.replace(" ", "")[4:] + iban[:4])
    assert iban[:2] == "DE" and iban[4] == " " and len(iban) == 27 and int(turned) % 97 == 1
    a, b = got[4].text.split(" and ")
    assert a != b.replace("s", "S", 1) and a == got[1].text
    assert got[5].text.split("@")[0][7:].encode() != b"" and all("α" <= c <= "ω" for c in got[5].text.split("@")[0].split(".")[1])


def test_long_texts_take_time_by_their_length(spark):
    import time

    began = time.time()
    got = replaced(spark, ["secret=" + "aB3" * 350_000, "x" * 1_000_000, "Mr Smith " * 20_000, "1 2 3 " * 100_000, "a.b " * 100_000 + "@"])
    assert time.time() - began < 60 and len(got[0].text) == 1_050_007 and got[2].n_entities == 20_000


def test_marks_in_texts(spark):
    from tessera.llm.pii import ESCAPE, GROUP, INSTEAD, MARK

    signs = "".join([MARK, GROUP, ESCAPE, *INSTEAD.values(), MARK, ESCAPE + INSTEAD[MARK]])
    got = replaced(spark, [f"{signs}bob@x.com{signs} Mr Smith {signs}Smith{signs}", signs])
    assert got[1].text == signs and got[0].text.count(signs) == 4 and got[0].n_entities == 3 and "Smith" not in got[0].text


def test_surrogates_against_plain_search(spark, rows):
    """Entities are those that a search place by place finds; surrogates are a one-to-one function of the entity."""
    from tessera.llm import pii

    r = random.Random(4)
    parts = [
        "Mr John Smith", "Mrs Smith", "Smith", "John", "Herr von Berg", "Frau Dr Berg", "bob@x.com", "BOB@X.COM", "x bob@y.org", "10.0.0.1", "10.0.0.10", "123-45-6789", "4111 1111 1111 1111", "4111111111111111", "+1 555 123 4567",
        "+15551234567", "(555) 123-4567", "password: hunter2hunter2", "token=123-45-6789", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "2001:db8:1:2:3:4:5:6", "c9c8b45435718dcc700c184a7e303cdc", "and then", "12", "Mr", "Mrs ", "Miss O'Neil-Smith", "г-н Петров", "\n", "=",
    ]
    texts = [t or "" for _, t in rows] + [r.choice(["", " ", ", "]).join(r.choices(parts, k=12)) for _ in range(300)]
    used, whole = {}, collections.defaultdict(set)
    for text, got in zip(texts, replaced(spark, texts), strict=True):
        want = brute.entities(text, pii.ALTERNATIVES, pii.INITIALS, pii.PARTICLES)
        assert [k for *_, k, _ in want] == list(got.kinds) and got.n_entities == len(want)
        shape, at = [], 0
        for b, e, _, units in want:
            shape.append(regex.escape(text[at:b]) + "(" + " ".join(["[^ ]+?"] * (1 + text[b:e].count(" "))) + ")")
            at = e
        m = regex.fullmatch("".join(shape) + regex.escape(text[at:]), got.text, regex.S)
        assert m, (text, got.text)
        if any(x[1] == y[0] for x, y in zip(want, want[1:])):
            continue  # where one ends and the next begins can't be seen
        for (b, e, kind, units), new in zip(want, m.groups(), strict=True):
            assert new != text[b:e] or kind == "name"
            if len(units) == 1 and units[0][0] not in ("given man", "given woman", "family"):
                key = (units[0][0], units[0][1] if units[0][0] == "secret" else regex.sub(r"[ \-()]", "", units[0][1].lower()))
                plain = new if kind == "secret" else regex.sub(r"[ \-()]", "", new.lower())
                assert used.setdefault(key, plain) == plain
                whole[key[0]].add(key[1])
            elif kind != "name" and len(units) == 1:
                assert used.setdefault(("family", units[0][1].lower()), new.lower()) == new.lower()
    by_kind = collections.defaultdict(list)
    for (kind, _), new in used.items():
        by_kind[kind].append(new)
    assert all(len(v) == len(set(v)) and not set(v) & whole[k] for k, v in by_kind.items())


def test_entities_after_signs(spark):
    """An entity may follow a sign that could be part of one, a letter of another script, or another entity."""
    from tessera.llm.pii import replace

    digits = "c9c8b45435718dcc700c184a7e303cdc"
    cases = [("_bob@corp.com_", "bob@", "email"), ("-bob@corp.com", "bob@", "email"), ("mailto:%20bob@corp.com", "bob@", "email"), ("+49 151 1234567bob@corp.com", "bob@", "email")]
    cases += [(f"{a}{digits}", digits, "secret") for a in ("key-", "sk_", "x.", "ключ")] + [(f"iban{a}DE89370400440532013000", "370400", "iban") for a in "-_.%"]
    cases += [(f"addr{a}2001:db8:1:2:3:4:5:6", "db8:1:2", "ip") for a in ("-", "_", ".", "r")] + [(f"password={a}hunterhunter", "hunterhunter", "secret") for a in "_-+/."] + [("token=AB12CDEFGHIJKLMN+restofit", "restofit", "secret")]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in replace(df, ["doc_id"]).collect()}
    assert [(t, kind) for i, (t, clear, kind) in enumerate(cases) if clear in got[i].text or kind not in got[i].kinds] == []


@pytest.mark.parametrize("most", [1000, 0])
def test_distinct_entities_stay_distinct(spark, most):
    """Single-digit addresses have few surrogates, so many collide and are drawn again."""
    from tessera.llm.pii import replace

    rows = [(i * 100 + j, f"at {i}.{j}.{i}.{j} and {i}.{j}.{i}.{j}") for i in range(1, 8) for j in range(1, 8)]
    got = {r.doc_id: r.text.split() for r in replace(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], most_constants=most).collect()}
    assert all(x[1] == x[3] for x in got.values())
    made = {x[1] for x in got.values()}
    assert len(made) == len(rows) and not made & {t.split()[1] for _, t in rows}


def test_what_draws_leave_is_numbered(spark, monkeypatch):
    """No draw again at all: what collides at first takes a number, and none takes what is in the corpus."""
    from pyspark.sql import functions as F

    from tessera.llm import pii

    monkeypatch.setattr(pii, "MOST_ATTEMPTS", 0)
    quads = [f"{i}.{j}.{k}.1" for i in range(1, 10) for j in range(1, 10) for k in range(1, 10)] + [f"100.100.100.{n}" for n in range(100, 110)]
    df = spark.createDataFrame(list(enumerate(f"at {q}" for q in quads)), "doc_id long, text string")
    from tessera.llm.common import Work

    again = {r.canonical: r.attempt for r in pii._collisions(Work(spark, "test"), df, pii.KEY).collect()}
    asked = spark.createDataFrame([(q, again.get(q, 0)) for q in quads], "match string, attempt long")
    made = [r.made for r in asked.select(pii.surrogate(F.lit("ip"), F.col("match"), F.col("attempt")).alias("made")).collect()]
    assert again and len(set(made)) == len(quads) and not set(made) & set(quads)
    kinds = {"email": "A@x.com", "ip": "1:2:3:4:5:6:7:8", "card": "4111 1111 1111 1111", "given man": "Иван", "given woman": "Anna", "family": "Иванов", "hex": "ab" * 16, "secret": "ab12ab12", "phone": "+49 151 123456", "iban": "DE89370400440532013000", "ssn": "123-45-6789"}
    rows = spark.createDataFrame([(k, m, n) for k, m in kinds.items() for n in range(1, 40)], "kind string, match string, attempt long")
    got = rows.select("kind", pii._canonical(F.col("kind"), pii.surrogate(F.col("kind"), F.col("match"), F.col("attempt"))).alias("made")).distinct()
    assert {r.kind: r["count"] for r in got.groupBy("kind").count().collect()} == dict.fromkeys(kinds, 39)


# -- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them, and we say so at length in a paragraph.</p></div><main><div class="content-%d"><h1>Title &amp; more</h1><p>First   para
graph with <b>bold</b> words.<p>Second &lt;para&gt;&nbsp;here.<ul><li>one<li>two</ul><aside>Read also</aside><form><p>Sign up</p></form><div class="comments"><p>A long reader comment that goes on and on and on.</p></div></div></main>
<div class="sidebar"><p>Side text that is long enough to count as a paragraph.</p></div><footer>Foot</footer><!-- <p>no</p> --></body></html>"""


def test_extraction(spark):
    from tessera.llm.html_text import main_text

    other = '<html><body><div class="teaser"><p>A long teaser text that is longer than the article itself, which is short, for once.</p></div><main><div class="content-9"><p>Short one.</p></div></main></body></html>'
    pages = [(1, "http://A.example/x", PAGE % 1), (2, "https://a.example:80/y", PAGE % 22), (3, "https://u@a.example/z", other), (4, None, PAGE % 3), (5, "nonsense", None), (6, "http://b.example", ""), (7, "http://b.example", "plain text"), (8, "http://b.example", "<p>" + "x" * 200_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for most in (1 << 20, 0):
        got = {r.page_id: r.text for r in main_text(df, most).collect()}
        want = "Title & more\n\nFirst para graph with bold words.\n\nSecond <para> here.\n\none\n\ntwo"
        assert got[1] == got[2] == got[4] == want
        assert got[3] == "Short one." and got[5] == got[6] == "" and got[7] == "plain text" and len(got[8]) == 200_000
    assert main_text(df.limit(0)).count() == 0
    assert all(r.n_chars == len(r.text) for r in main_text(df.unionByName(df)).collect())


LONG = "A sentence of the article that is long enough to count as text, with commas, and a full stop."


@pytest.mark.parametrize("page, want", [
    (f'<body><div class="site has-sidebar"><p>{LONG}</p></div><div class="sidebar"><p>Side, side.</p></div>', [LONG]),
    (f'<body><article class="no-sidebar"><h1>T</h1><p>{LONG}</p></article>', ["T", LONG]),
    (f'<body><form id="aspnetForm"><div id="c"><h1>T</h1><p>{LONG}</p></div><div class="footer"><p>Foot</p></div></form>', ["T", LONG]),
    (f'<body><main id="search-journal"><p>{LONG}</p></main><form><p>Search here, please</p></form>', [LONG]),
    (f'<body><article><p>{LONG}</p><div class="related-work"><p>Others did so, too.</p></div><div class="related-posts"><p>More</p></div></article>', [LONG, "Others did so, too."]),
    (f'<body><article><section class="lead"><p>{LONG}</p></section><section class="body"><p>Second part.</p><p>Third.</p></section></article>', [LONG, "Second part.", "Third."]),
    (f'<body><article><header><h1>T</h1></header><div class="text"><p>{LONG}</p></div></article>', ["T", LONG]),
    (f"<body><div class=post><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></div>", [LONG + " x=1"]),
    (f'<body><article><p title="5" tall">{LONG}</p><p class=\'a"b\'>Next > one</p></article>', [LONG, "Next > one"]),
    (f'<body><article><p>{LONG}</p></article><div class="comments"><article class="comment"><p>{LONG} {LONG} {LONG}</p></article></div>', [LONG]),
    (f'<body><div class="post"><div class="part"><p>{LONG}</p></div><div class="part"><p>{LONG}</p></div></div><div class="teaser"><p>Tease.</p></div>', [LONG, LONG]),
    ("<body>" + "<div>" * 3000 + f"<p>{LONG}</p>", [LONG]),
    (f"<body><article><p>{LONG}</p><button>Share</button><p>a &lt; b<br>c</p></article>", [LONG, "a < b c"]),
])
def test_marks_weigh_and_do_not_decide(page, want):
    from tessera.llm.html_text import extract

    assert extract(page, None).split("\n\n") == want


def test_generated_pages(spark):
    """Pages put together from an article and what surrounds it: the article alone comes out, as it was put in."""
    from tessera.llm.html_text import main_text

    r = random.Random(8)
    boiler = ['<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>', "<script>var x = '<p>no</p>';</script>", '<div class="cookie-box"><p>We use cookies, and say so.</p></div>', '<aside><p>Read this, too, it is long, and nice.</p></aside>', '<div id="sidebarRight"><p>A side, with text.</p></div>', '<div class="ad">Buy, buy.</div>']
    body = [("<p>{}</p>", 1), ("<p>{}", 1), ("<h2>{}</h2>", 1), ("<ul><li>{}</li><li>{}</li></ul>", 2), ("<blockquote><p>{}</p></blockquote>", 1), ("<section><p>{}</p><p>{}</p></section>", 2), ("<pre>{}</pre>", 1), ("<table><tr><td>{}<td>{}</table>", 2)]
    pages, want = [], []
    for i in range(120):
        lines, inside = [], []
        for shape, k in [r.choice(body) for _ in range(r.randint(3, 9))] + [body[0]] * 3:
            got = [f"{base_text(1000 * i + len(lines) + j, r.randint(8, 40))}, that." for j in range(k)]
            lines += got
            inside.append(shape.format(*[x.replace(" ", r.choice([" ", "  ", "\n", " <b></b>"]), 1) for x in got]))
            if r.random() < 0.2:
                inside.append(r.choice(boiler))
        tag = ["article", "main", 'div class="story"'][i % 3]
        around = [r.choice(boiler) for _ in range(4)]
        pages.append((i, f"http://h{i % 3}.example/{i}", "<html><head><title>T</title></head><body>" + "".join(around[:2]) + f"<{tag}>" + "".join(inside) + f"</{tag.split()[0]}>" + "".join(around[2:]) + "<footer><p>Foot, foot, foot.</p></footer></body></html>"))
        want.append((i, "\n\n".join(lines)))
    got = main_text(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as kept", "2 as host", "3 as winning", "4 as text"), keep=["kept", "host", "winning", "text"])
    assert got.columns == ["page_id", "url", "text", "n_chars", "kept", "host", "winning"]
    assert sorted((x.page_id, x.text) for x in got.collect()) == want


LONG = "A sentence of the article that is long enough to count as text, with commas, and a full stop."


@pytest.mark.parametrize("page, want", [
    (f'<body><div class="site has-sidebar"><p>{LONG}</p></div><div class="sidebar"><p>Side, side.</p></div>', [LONG]),
    (f'<body><article class="no-sidebar"><h1>T</h1><p>{LONG}</p></article>', ["T", LONG]),
    (f'<body><form id="aspnetForm"><div id="c"><h1>T</h1><p>{LONG}</p></div><div class="footer"><p>Foot</p></div></form>', ["T", LONG]),
    (f'<body><main id="search-journal"><p>{LONG}</p></main><form><p>Search here, please</p></form>', [LONG]),
    (f'<body><article><p>{LONG}</p><div class="related-work"><p>Others did so, too.</p></div><div class="related-posts"><p>More</p></div></article>', [LONG, "Others did so, too."]),
    (f'<body><article><section class="lead"><p>{LONG}</p></section><section class="body"><p>Second part.</p><p>Third.</p></section></article>', [LONG, "Second part.", "Third."]),
    (f'<body><article><header><h1>T</h1></header><div class="text"><p>{LONG}</p></div></article>', ["T", LONG]),
    (f"<body><div class=post><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></div>", [LONG + " x=1"]),
    (f'<body><article><p title="5" tall">{LONG}</p><p class=\'a"b\'>Next > one</p></article>', [LONG, "Next > one"]),
    (f'<body><article><p>{LONG}</p></article><div class="comments"><article class="comment"><p>{LONG} {LONG} {LONG}</p></article></div>', [LONG]),
    (f'<body><div class="post"><div class="part"><p>{LONG}</p></div><div class="part"><p>{LONG}</p></div></div><div class="teaser"><p>Tease.</p></div>', [LONG, LONG]),
    ("<body>" + "<div>" * 3000 + f"<p>{LONG}</p>", [LONG]),
    (f"<body><article><p>{LONG}</p><button>Share</button><p>a &lt; b<br>c</p></article>", [LONG, "a < b c"]),
])
def test_marks_weigh_and_do_not_decide(page, want):
    from tessera.llm.html_text import extract

    assert extract(page, None).split("\n\n") == want


def test_generated_pages(spark):
    """Pages put together from an article and what surrounds it: the article alone comes out, as it was put in."""
    from tessera.llm.html_text import main_text

    r = random.Random(8)
    boiler = ['<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>', "<script>var x = '<p>no</p>';</script>", '<div class="cookie-box"><p>We use cookies, and say so.</p></div>', '<aside><p>Read this, too, it is long, and nice.</p></aside>', '<div id="sidebarRight"><p>A side, with text.</p></div>', '<div class="ad">Buy, buy.</div>']
    body = [("<p>{}</p>", 1), ("<p>{}", 1), ("<h2>{}</h2>", 1), ("<ul><li>{}</li><li>{}</li></ul>", 2), ("<blockquote><p>{}</p></blockquote>", 1), ("<section><p>{}</p><p>{}</p></section>", 2), ("<pre>{}</pre>", 1), ("<table><tr><td>{}<td>{}</table>", 2)]
    pages, want = [], []
    for i in range(120):
        lines, inside = [], []
        for shape, k in [r.choice(body) for _ in range(r.randint(3, 9))] + [body[0]] * 3:
            got = [f"{base_text(1000 * i + len(lines) + j, r.randint(8, 40))}, that." for j in range(k)]
            lines += got
            inside.append(shape.format(*[x.replace(" ", r.choice([" ", "  ", "\n", " <b></b>"]), 1) for x in got]))
            if r.random() < 0.2:
                inside.append(r.choice(boiler))
        tag = ["article", "main", 'div class="story"'][i % 3]
        around = [r.choice(boiler) for _ in range(4)]
        pages.append((i, f"http://h{i % 3}.example/{i}", "<html><head><title>T</title></head><body>" + "".join(around[:2]) + f"<{tag}>" + "".join(inside) + f"</{tag.split()[0]}>" + "".join(around[2:]) + "<footer><p>Foot, foot, foot.</p></footer></body></html>"))
        want.append((i, "\n\n".join(lines)))
    got = main_text(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as kept", "2 as host", "3 as winning", "4 as text"), keep=["kept", "host", "winning", "text"])
    assert got.columns == ["page_id", "url", "text", "n_chars", "kept", "host", "winning"]
    assert sorted((x.page_id, x.text) for x in got.collect()) == want


# -- mixture


def test_budgets_fill_like_water(spark):
    from tessera.llm.mixing import budgets

    r = random.Random(5)
    leaves = [(f"d{r.randrange(3)}", f"l{r.randrange(3)}", f"s{i}", r.choice([0, 5, 50, 500, 5000])) for i in range(25)]
    weights = {"domain": {"d0": 3, "d1": 2}, "lang": {"l0": 5}, "source": {"s3": 0, "s4": 7}}
    got = {(x.domain, x.lang, x.source): x.budget for x in budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), 9000, weights, 2).collect()}

    def fill(budget, level, rows):
        if level == 3:
            return {rows[0][:3]: budget}
        groups = collections.defaultdict(list)
        for x in rows:
            groups[x[level]].append(x)
        name = ("domain", "lang", "source")[level]
        parts = brute.water(budget, {k: (sum(2 * x[3] for x in v), weights[name].get(k, 1)) for k, v in groups.items()})
        out = {}
        for k, v in groups.items():
            out |= fill(parts[k], level + 1, v)
        return out

    want = fill(9000, 0, leaves)
    assert all(abs(got[k] - want[k]) <= 3 for k in want)


def test_mixture(docs, odd, empty):
    from tessera.llm.mixing import mix

    got = mix(docs, weights={"lang": {"en": 5}}, target_share=0.7).collect()
    by_leaf = collections.defaultdict(list)
    for r in got:
        by_leaf[r.domain, r.lang, r.source].append(r)
    for rs in by_leaf.values():
        used = sum(r.n_tokens * r.copies for r in rs)
        assert used <= rs[0].leaf_budget and max(r.copies for r in rs) - min(r.copies for r in rs) <= 1 and max(r.copies for r in rs) <= 2
    assert [tuple(r) for r in sorted(got)] == [tuple(r) for r in sorted(mix(docs.repartition(3), weights={"lang": {"en": 5}}, target_share=0.7).collect())]
    assert mix(empty).count() == 0
    whole = mix(odd, target_share=1.0, max_epochs=1, keep=odd.columns)
    assert whole.columns == [*odd.columns, "copies"] and {r.doc_id for r in whole.collect()} >= {4, 5, 10, 13}
    assert mix(repeated(odd), target_share=1.0, max_epochs=1, keep=odd.columns).filter("doc_id = 10").count() == 2
    clashing = odd.selectExpr("*", "7L as copies", "8 as own")
    got = mix(clashing, target_share=1.0, max_epochs=1, keep=clashing.columns)
    assert got.columns.count("copies") == 1 and {(r.copies, r.own, r.text_hash) for r in got.collect()} == {(1, 8, None)}


def test_drawn_documents_are_the_prefix_of_the_stream(spark):
    """Epoch after epoch in one order, as far as the budget reaches, by plain addition over the drawn order."""
    from pyspark.sql import functions as F

    from tessera.llm.mixing import mix

    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["en", "de", None]), r.choice(["a", "b", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    size = {d: len(t.split()) for d, t, *_ in rows}
    for share, epochs in ((0.4, 3), (1.5, 3), (2.9, 3)):
        got = mix(docs, weights={"lang": {"en": 3}, "source": {"a": 2}}, target_share=share, max_epochs=epochs)
        copies = {x.doc_id: x.copies for x in got.collect()}
        leaves = {(x.lang, x.source): (x.leaf_tokens, x.leaf_budget) for x in got.collect()}
        whole = {k: b // t for k, (t, b) in leaves.items()}
        at = {x.doc_id: x.h for x in docs.select("doc_id", F.xxhash64(F.lit(17), F.coalesce(*[F.when(F.col("lang").eqNullSafe(F.lit(k[0])) & F.col("source").eqNullSafe(F.lit(k[1])), F.lit(n).cast("long")) for k, n in whole.items()], F.lit(0).cast("long")), "doc_id", F.xxhash64("text")).alias("h")).collect()}
        for key, (tokens, budget) in leaves.items():
            ids = sorted((d for d, _, lang, source in rows if (lang, source) == key), key=lambda d: (at[d], d))
            assert sum(size[d] for d in ids) == tokens
            left = budget - whole[key] * tokens
            want, total = {d: whole[key] for d in ids}, 0
            for d in ids:
                total += size[d]
                if total > left or left == 0:
                    break
                want[d] += 1
            assert {d: copies.get(d, 0) for d in ids} == want


# -- shards


def check_shards(rows, got, n):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    target = sum(r.size for r in got) / n
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    largest = max(r.size for r in got)
    for s, rs in by.items():
        assert 0 <= s < n and sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - target) <= largest or len(by) < n
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_shards(docs, rows, odd, odd_rows, empty):
    from tessera.llm.sharding import assign_shards

    check_shards(rows, assign_shards(docs).collect(), 40)
    check_shards(odd_rows, assign_shards(odd, n_shards=3).collect(), 3)
    assert assign_shards(empty).count() == 0
    assert assign_shards(repeated(odd)).count() == repeated(odd).count()


def test_written_shards(spark, docs, tmp_path):
    from tessera.llm.sharding import write_shards

    write_shards(docs, str(tmp_path / "shards"), n_shards=4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_written_shards_of_odd_rows(spark, odd, tmp_path):
    from tessera.llm.sharding import write_shards

    rows = repeated(odd)
    write_shards(rows, str(tmp_path / "odd"), n_shards=3)
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back.collect()))) == sorted(map(repr, ((r.doc_id, r.text) for r in rows.collect())))
    slots = sorted((r.shard, r.slot) for r in back.collect())
    assert slots == [(s, i) for s in sorted({s for s, _ in slots}) for i in range(sum(x == s for x, _ in slots))]


# -- language


def test_languages(docs, odd, empty):
    from tessera.llm.language import UNKNOWN, identify

    got = {r.doc_id: r for r in identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d, r in got.items() if r.held_out]
    assert held and all(zlib.crc32(str(d).encode()) % 4 == 2 for d in held)
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())
    few = {r.doc_id: r.lang_pred for r in identify(odd).collect()}
    assert few[1] == few[2] == few[15] == few[19] == UNKNOWN and few[10] == "en"
    assert identify(empty).count() == 0
    wide = identify(odd, per_lang=3, landmarks=2, max_grams=500, keep=odd.columns)
    assert wide.columns == ["doc_id", "held_out", "lang_pred", "score", *[c for c in odd.columns if c not in ("doc_id", "score")]] and wide.count() == odd.count()
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in identify(repeated(odd).withColumn("lang", F.lit(None).cast("string"))).collect()} == {UNKNOWN}


def test_language_model_against_a_dense_solve():
    """Margins of the fitted model are those of ridge regression under the Nystrom kernel, solved in full."""
    from tessera.llm.language import RIDGE, fit, presence

    r = random.Random(6)
    texts = [("".join(r.choice(a) for _ in range(80)), lang) for lang, a in (("x", "abcd "), ("y", "cdefg "), ("z", "fgha ")) for _ in range(25)]

    def codes(t):
        return sorted({c for n, first in ((1, 0), (2, 256), (3, 65792)) for c in (int.from_bytes(t[i : i + n].encode(), "big") + first for i in range(len(t) - n + 1))})

    model = fit([(lang, np.array(codes(t))) for t, lang in texts], ["x", "y", "z"], landmarks=6)
    sets = [set(codes(t)) & set(model.codes.tolist()) for t, _ in texts]
    chosen = [i for lang in "xyz" for i in [k for k, (_, x) in enumerate(texts) if x == lang][:6]]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k_nm = np.array([[kernel(a, sets[i]) for i in chosen] for a in sets])
    near = k_nm @ np.linalg.pinv(k_nm[chosen], rcond=1e-6) @ k_nm.T
    y = np.array([[1.0 if lang == x else -1.0 for x in "xyz"] for _, lang in texts])
    want = near @ np.linalg.solve(near + RIDGE * len(texts) * np.eye(len(texts)), y)
    buf = np.frombuffer("".join(t for t, _ in texts).encode(), np.uint8)
    got = model.margins(buf, np.arange(len(texts) + 1) * 80, model.table())
    assert np.abs(got - want).max() < 1e-3
    seen = presence(buf, np.arange(len(texts) + 1) * 80, model.table(), len(model.codes))
    assert [set(model.codes[x > 0].tolist()) for x in seen] == sets


# -- pipeline


def test_pipeline(spark, tiny, rows):
    import corpus_pipeline
    from tessera.llm.quality import judge

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = {r.doc_id for r in judge(docs, spark.read.parquet(f"{tiny}/labels.parquet")).filter("kept").collect()}
    left = [(d, t) for d, t in rows if d in kept]
    left = [(d, t) for d, t in left if d in {c for _, _, c in brute.jaccard_components(left, corpus_pipeline.NEAR["shingle"], corpus_pipeline.NEAR["percent"])}]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    dirty = {d for d, *_ in brute.contained(left, items)}
    left = [(d, t) for d, t in left if d not in dirty]
    got = corpus_pipeline.run(spark, tiny).collect()
    mine = {r.doc_id for r in got}
    assert mine <= {d for d, _ in left}
    words = {d: len(brute.words(t)) for d, t in left}
    assert sum(words[d] for d in mine) >= 0.8 * corpus_pipeline.MIX_SHARE * sum(words.values())
    check_shards([(d, t) for d, t in left if d in mine], got, 40)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][-1] == "sharding"
