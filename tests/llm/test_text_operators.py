"""Quality, near duplicates, secrets, personal data, mixing: against brute force, and odd input."""
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyfolio.llm import mixing, pii, quality, secrets, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word other third " * 20_000


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, (t, lang, src) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", None, 0), (3, LONG, None, "s", 9),
            (4, "a b c", "en", "s", 5), (4, "a b c", "en", "s", 5), (5, " \t\n\x0b\x0c\r ", "en", "t", 7),
            (6, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", "t", 1)]
    extra = ("quality", "n_words", "row", "copies", "fp", "component_id", "ids", "spans", "size", "target", "limit", "_words",
             "_Repeats", "kept_row", "mix_row", "simhash_row", "doc", "pick_row")
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in extra})


# ------------------------------------------------------------------ quality

def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_counts_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "\n\n", LONG] + [
        "".join(rng.choice(["ab", "c", "é", "𝄞", " ", "  ", "\n", "\t", "#", "x y z ", " "]) for _ in range(rng.randint(0, 200)))
        for _ in range(150)]
    got = quality.measured(table(spark, [(t, "en", "s") for t in texts])).select("doc_id", "quality.*").orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == list(map(counts, texts))


def test_buckets_keep_small_values_and_round_large_ones_down(spark):
    df = spark.range(0, 5000).select("id", quality.bucket(F.col("id")).alias("b")).collect()
    assert all(r.b == r.id if r.id < 64 else r.b <= r.id < r.b * 33 / 32 for r in df)


def test_junk_goes_and_clean_documents_stay(spark):
    rng = random.Random(2)

    def words(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n)]
    rows = []
    for i in range(450):
        src = "hot" if i % 3 else f"s{i % 7}"
        ws = words(80)
        rows.append((" ".join(w + "###" for w in ws) if i % 9 == 0 else " ".join(ws), "en", src))
    got = {r.doc_id for r in quality.keep_good(table(spark, rows)).collect()}
    assert got == {i for i in range(450) if i % 9}


def test_fences_follow_their_source_not_constants(spark):
    """A clean source beside a junky one, and a source whose habit is symbols, in a language of its own."""
    rng = random.Random(4)

    def doc(symbols):
        ws = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(200)]
        return " ".join(w + "#" if i < symbols else w for i, w in enumerate(ws))
    rows = [(doc(rng.randint(0, 2)), "en", "clean") for _ in range(300)] + [(doc(rng.randint(60, 199)), "en", "junky") for _ in range(120)]
    rows += [(doc(rng.randint(20, 30)), "code", "habit") for _ in range(200)]
    rows += [(doc(30), "en", "clean"), (doc(45), "code", "habit"), (doc(150), "code", "habit")]
    got = {r.doc_id: r.verdict for r in quality.judged(table(spark, rows), out="verdict").collect()}
    assert all(got[i].kept for i in range(300)) and all(got[i].kept for i in range(420, 620))
    # 150 symbols per 1000 words are far out among clean texts; among habitual ones they are not, 750 are.
    assert [got[i].kept for i in (620, 621, 622)] == [False, True, False]
    limits = {r.source: r.symbol_rate for r in quality.thresholds(quality.sketches(
        quality.measured(table(spark, rows)))).collect()}
    assert limits["clean"] < 100 < limits["habit"] < limits["junky"]


def test_small_groups_lean_on_their_language(spark):
    rows = [("word " * 10 + " ".join(f"w{i}x{j}" for j in range(60)), "en", "large") for i in range(300)]
    rows += [("".join(f"w{i}y{j}# " for j in range(60)), "en", "tiny") for i in range(3)]
    got = quality.judged(table(spark, rows), out="verdict").filter("source = 'tiny'").collect()
    assert len(got) == 3 and not any(r.verdict.kept for r in got)


def test_quality_of_odd_rows(spark, odd):
    judged = quality.judged(odd, out="verdict")
    assert judged.count() == odd.count() and judged.filter("verdict.kept").count() == 0
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.keep_good(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality.judged(odd)


# ------------------------------------------------------------------ near duplicates

def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "One", "one TWO", "a b c d A B C", "é É x\ny\tz w", LONG[:999]])
def test_fingerprint(text):
    assert simhash.fingerprint(simhash.hashes(text)) == plain_print(text)


def close_pairs(prints, radius):
    return {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints))
            if bin(int(prints[i]) ^ int(prints[j])).count("1") <= radius}


def near_prints(n, seed=0):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n)]
    flips = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))) for b in base for _ in range(2)]
    return np.array(sorted({*base, *flips}), np.uint64)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_sliced_pairs(radius):
    prints = near_prints(90)
    i, j = simhash._pairs_within(prints, np.full(len(prints), len(prints)), radius)
    assert set(zip(i.tolist(), j.tolist())) == close_pairs(prints, radius)


def components(prints, radius=2):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, j in close_pairs(prints, radius):
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("small_buckets", [False, True])
def test_groups(spark, monkeypatch, small_buckets):
    """Chains of links, and buckets that are larger than a task takes whole."""
    if small_buckets:
        monkeypatch.setattr(simhash, "WHOLE", 4)
        monkeypatch.setattr(simhash, "CHUNK", 3)
    prints = near_prints(60, 5).tolist()
    chain = [prints[0]]
    for b in range(3, 60, 2):
        chain.append(chain[-1] ^ (3 << b))
    hot = [(0xABCD << 48) | (0x1234 << 32) | x for x in range(40)]     # share two blocks
    prints = sorted({*prints, *chain, *hot})
    rows = [(i, int(np.array([p], np.uint64).view(np.int64)[0])) for i, p in enumerate(prints)]
    got = simhash.grouped(spark.createDataFrame(rows, "id bigint, fp bigint")).collect()
    ids = {fp: i for i, fp in rows}
    assert {ids[r.fp]: r.component_id for r in got} == dict(enumerate(components(prints)))


def test_registered_fingerprints_and_groups(spark):
    """The contract's columns of the whole small table, by brute force."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in simhash.op5_simhash(spark, "/root/testdata/sf0.001").collect()}
    ids = sorted(docs)
    prints = [plain_print(docs[i]) for i in ids]
    root = list(range(len(ids)))
    for a, b in sorted(close_pairs(prints, 2)):
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {
        i: (f"{p:016x}", ids[root[k]]) for k, (i, p) in enumerate(zip(ids, prints))}


def test_prefix_pairs_lose_no_similar_pair(spark):
    rng = random.Random(13)
    common = [rng.getrandbits(62) for _ in range(400)]
    sets = []
    for _ in range(120):
        n = rng.randint(1, 60)
        base = rng.choice(sets)[:] if sets and rng.random() < 0.5 else rng.sample(common, n)
        for _ in range(rng.randint(0, 6)):
            base[rng.randrange(len(base))] = rng.getrandbits(62)
        sets.append(sorted(set(base)))
    df = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "member bigint, n bigint, shingles array<bigint>")
    got = {tuple(sorted((r.one, r.two))) for r in simhash.prefix_pairs(df).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
    assert want <= got and len(want) > 10 and len(got) < 10 * len(want)


def test_a_common_passage_makes_no_pairs(spark):
    rng = random.Random(14)
    passage = [rng.getrandbits(62) for _ in range(300)]
    sets = [passage + [rng.getrandbits(62) for _ in range(100)] for _ in range(200)]
    df = spark.createDataFrame([(i, 400, s) for i, s in enumerate(sets)], "member bigint, n bigint, shingles array<bigint>")
    assert simhash.prefix_pairs(df).count() == 0


def test_one_document_of_each_group_stays(spark, odd):
    rows = [("the same text of some words " * 3, "en", "s")] * 5 + [(f"quite another text number {i} with own words {i * 7}", "en", "s") for i in range(3)]
    docs = table(spark, rows)
    assert {r.doc_id for r in simhash.first_of_each(docs).collect()} >= {0, 5} and simhash.first_of_each(docs).count() <= 4
    kept = simhash.first_of_each(odd).collect()
    # empty, null and blank texts are one group; the repeated row stays once
    assert sorted(r.doc_id for r in kept) == [1, 3, 4, 6] and len(kept[0]) == len(odd.columns)
    assert simhash.first_of_each(odd.limit(0)).count() == 0
    near = {(r.id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert near == {(None, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 1), (6, 6)}


@pytest.mark.parametrize("star_rounds", [6, 0])
def test_linked_fingerprints_are_candidates_of_the_stage(spark, monkeypatch, star_rounds):
    """Without any band, of what the fingerprints link the similar texts go, and only those."""
    monkeypatch.setattr(simhash, "STAR_ROUNDS", star_rounds)
    monkeypatch.setattr(simhash, "band_keys", lambda found: np.empty(0, np.int64))
    rng = random.Random(15)

    def words(n):
        return [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    base, passage = words(403), words(31) * 60      # odd numbers of shingles: no bit is a tie
    texts = [" ".join(w) for w in (base, passage + words(20), base[:-1] + ["other"], words(400), passage + words(20))]
    prints = [simhash.fingerprint(simhash.hashes(t, simhash.STAGE_SHINGLE)) for t in texts]
    sets = [simhash.shingle_set(t) for t in texts]
    assert max((prints[a] ^ prints[b]).bit_count() for a, b in ((0, 2), (1, 4))) <= 2
    assert simhash.similar(sets[0], sets[2]) and not simhash.similar(sets[1], sets[4])
    got = sorted(r.doc_id for r in simhash.first_of_each(table(spark, [(t, "en", "s") for t in texts])).collect())
    assert got == [0, 1, 3, 4]


@pytest.mark.parametrize("star_rounds", [6, 0])
def test_documents_similar_to_a_staying_one_go(spark, monkeypatch, star_rounds):
    """Similarities around 0.8, chains of links, copies and null ids, against all pairs in order of ids."""
    monkeypatch.setattr(simhash, "STAR_ROUNDS", star_rounds)
    rng = random.Random(12)
    rows = []
    for g in range(25):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randint(60, 150))]
        rows.append((" ".join(words), "en", "s"))
        for _ in range(6):
            if rng.random() < 0.5:
                words = list(words)     # a chain: each from the one before
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((" ".join(changed), "en", "s"))
            words = changed if rng.random() < 0.7 else words
    rng.shuffle(rows)

    def shingles(text):
        words = text.split()
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
    sets, want = [shingles(t) for t, _, _ in rows], []
    for i, s in enumerate(sets):
        if not any(10 * len(s & sets[k]) >= 8 * len(s | sets[k]) for k in want):
            want.append(i)
    got = sorted(r.doc_id for r in simhash.first_of_each(table(spark, rows)).collect())
    assert got == want and 25 < len(want) < len(rows) - 25


# ------------------------------------------------------------------ secrets

WORDS = {"secret": 3, "available": 90, "correct": 50, "horse": 80, "the": 1}


def base_secrets(text):
    found = [("assign", *m.span()) for m in re.finditer(
        r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_secrets_match_brute_force():
    rng = random.Random(4)
    parts = ["token", "API_KEY", "api key", "=", ":", " ", '"', "deadbeefcafe0123", "abc", "AKIA", "ABCDEFGHIJ2345", "éß", "passwd", "ſecret", "x" * 14]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        got = [(s.kind, s.start, s.end) for s in secrets.find_spans(text, WORDS) if s.base]
        assert got == base_secrets(text), text


def test_guess_costs_order_values():
    cost = {v: secrets.guess_bits(v, WORDS) for v in (
        "available", "correcthorse", "qwertyuiop", "aaaaaaaaaaaa", "abcabcabcabc", "2024-05-17", "x8Kq2!mZ9pLw", "abcdefghij")}
    assert max(cost[v] for v in cost if v != "x8Kq2!mZ9pLw") < 35 < 50 < cost["x8Kq2!mZ9pLw"]
    assert secrets.guess_bits("", WORDS) == 0
    # no segmentation costs more than single characters
    assert all(secrets.guess_bits(v + v, WORDS) <= 2 * secrets.guess_bits(v, WORDS) + 4 for v in cost)


def test_context_values_are_added_and_masked(spark, odd):
    words = secrets.ranked_words(secrets.words_path())
    text = "my password is x8Kq2!mZ9pLw. The token was available, the secret unquestionably safe. pwd=Tr0ub4dor&3xyz9Q"
    spans = secrets.find_spans(text, words)
    assert [text[s.value:s.end] for s in spans] == ["x8Kq2!mZ9pLw", "Tr0ub4dor&3xyz9Q"] and not any(s.base for s in spans)
    assert "[SECRET]" in secrets.masked(text, spans) and "x8Kq2" not in secrets.masked(text, spans)
    masked = secrets.mask_secrets(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    got = {r.doc_id: r.text for r in masked.collect()}
    assert got[6] == 'token = "[SECRET]"' and got[2] is None and got[3] == LONG
    assert secrets.mask_secrets(odd.limit(0)).count() == 0


@pytest.mark.parametrize("text", [
    "bearer token: h7#Kq!9zP@w2", "secret password: h7#Kq!9zP@w2", "secret password:h7#Kq!9zP@w2", "DB_PASSWORD=h7#Kq!9zP@w2",
    "MYSQL_PASSWORD: h7#Kq!9zP@w2", "my_api_key=h7#Kq!9zP@w2", "dbPassword = h7#Kq!9zP@w2"])
def test_every_value_in_context_is_judged(text):
    words = secrets.ranked_words(secrets.words_path())
    assert [text[s.value:s.end] for s in secrets.find_spans(text, words) if not s.base] == ["h7#Kq!9zP@w2"]


def test_assigned_letters_are_judged_by_cost():
    words = secrets.ranked_words(secrets.words_path())
    assert [s.value for s in secrets.find_spans("pwd=xqzjvkwpgf", words)] == [4]
    assert [s.value for s in secrets.find_spans("Credentials: Xqzjvkwpgf", words)] == [13]
    for text in ("pwd: available", "pwd xqzjvkwpgf", "bearer token: available"):
        assert not secrets.find_spans(text, words)
    assert len(secrets.find_spans("token=" * 20_000, words)) == 1


def cheapest(value, words):
    """The cost of the best of all segmentations, piece by piece as they are defined."""
    low, n = value.lower(), len(value)
    plain = "".join(secrets.LEET.get(c, c) for c in low)
    near, rows = secrets._neighbours(), secrets.ROWS_AT
    inf = float("inf")

    def run_start(j, joins):
        i = j - 1
        while i > 0 and joins(i - 1, i, j):
            i -= 1
        return i

    def piece(i, j):
        c = [inf]
        if j == i + 1:
            fresh = i == 0 or value[i].isdigit() != value[i - 1].isdigit() or value[i].isalpha() != value[i - 1].isalpha()
            c.append(secrets._char_bits(value[i]) + (secrets._PIECE / 2 if fresh else 0))
        if j - i >= 3:
            c += [secrets._PIECE + secrets._word_bits(value[i:j], p, words[p]) for p in {low[i:j], plain[i:j]} if p in words]
            step = ord(low[j - 1]) - ord(low[j - 2])
            if abs(step) <= 1 and i == run_start(j, lambda a, b, _: ord(low[b]) - ord(low[a]) == step):
                c.append(secrets._PIECE + math.log2(52) + math.log2(j - i))
            if i == run_start(j, lambda a, b, _: (low[a], low[b]) in near):
                at = [rows[x] for x in low[i:j]]
                turns = sum(b - a != d - b for a, b, d in zip(at, at[1:], at[2:]))
                c.append(secrets._PIECE + math.log2(47) + math.log2(j - i) + math.log2(4.6) * (1 + turns))
        if j - i in (4, 6, 8, 10) and secrets._DATE.fullmatch(value[i:j]):
            c.append(secrets._PIECE + (math.log2(120) if j - i == 4 else math.log2(365 * 120) + 1))
        for u in range(1, i + 1):
            m, rest = divmod(j - i, u)
            if not rest and value[i - u:i] * m == value[i:j]:
                c.append(secrets._REPEAT + math.log2(m))
        place = secrets._PLACE.match(value) if i == 0 else None
        if place and place.end() == j:
            c.append(secrets._PIECE + secrets._PLACE_BITS + len(secrets._SEPARATORS.findall(place[0])) / 2)
        return min(c)

    best = [0.0] + [inf] * n
    for j in range(1, n + 1):
        best[j] = min(best[i] + piece(i, j) for i in range(j))
    return best[n]


def test_guess_costs_equal_all_segmentations():
    rng = random.Random(6)
    words = {"secret": 3, "horse": 80, "the": 1, "abcab": 7, "passw": 9}
    pieces = ["secret", "s3cret", "horse", "the", "a", "b", "ab", "abc", "qwe", "asdf", "12", "2024", "2024-05-17", "#", "Z", "x9", ".", "/"]
    for _ in range(1500):
        value = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))
        want = cheapest(value, words)
        assert secrets.guess_bits(value, words) == pytest.approx(want), value
        for enough in (8.0, 20.0, 36.0):
            assert (secrets.guess_bits(value, words, enough) >= enough) == (want >= enough - 1e-9), value


def test_no_piece_has_a_greatest_length():
    words = {"antidisestablishmentarianisms": 5, "the": 1}
    unit = "xK2#pQ9!zL4@vB7$mN1%tR6^wH3&"
    once = secrets.guess_bits(unit, words)
    assert secrets.guess_bits(unit * 3, words) < once + 5
    assert secrets.guess_bits("antidisestablishmentarianisms", words) < 10
    assert secrets.guess_bits("asdfghjkl;'" + "lkjhgfdsasdfghjkl" * 6, words) < 150


def test_addresses_of_pages_are_no_secrets():
    words = secrets.ranked_words(secrets.words_path())
    rng = random.Random(9)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 12)))
    for _ in range(200):
        for value in (f"https://example.com/{word()}/{word()}/index.html", f"/{word()}/{word()}/{word()}.txt", f"{word()}.{word()}.{word()}"):
            assert not [s for s in secrets.find_spans(f"see token {value} for more", words) if not s.base], value
    assert [s for s in secrets.find_spans("token https://example.com/T0x9/Kd82hsQp1ZmXw77a", words) if not s.base]


def test_short_random_values_are_found():
    words = secrets.ranked_words(secrets.words_path())
    rng = random.Random(10)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    found = sum(bool(secrets.find_spans("pwd: " + "".join(rng.choice(letters) for _ in range(8)), words)) for _ in range(300))
    assert found >= 0.9 * 300


def test_many_and_long_values_take_time_in_proportion():
    words = secrets.ranked_words(secrets.words_path())
    rng = random.Random(11)
    lines = [f"password = {rng.randrange(10 ** 15):015d}x and token is h7#Kq!9zP@{i}" for i in range(20_000)]
    start = time.perf_counter()
    spans = secrets.find_spans("\n".join(lines), words)
    assert len(spans) == 40_000
    for value in ("x8Kq2!mZ" * 100_000, "ab" * 300_000, "!" * 500_000, "".join(rng.choice("aB3$x") for _ in range(500_000))):
        secrets.find_spans("secret: " + value, words)
    assert time.perf_counter() - start < 60


def test_registered_secrets_keep_the_base(spark):
    """The contract's columns of the whole small table, against patterns run plainly."""
    got = {r.doc_id: r for r in secrets.op4_secrets(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base = base_secrets(d.text or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in secrets.KINDS)
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))


# ------------------------------------------------------------------ personal data

FORMATS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_pii(text):
    def fine(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
    return [(k, *m.span()) for k in pii.KINDS for m in re.finditer(FORMATS[k], text) if fine(k, m[0])]


def test_base_spans_match_brute_force():
    rng = random.Random(6)
    parts = ["a", "b.c", "@", ".", "-", " ", "+1", "(659)", "555", "0", "4111111111111111", "192.168", "1.2.3.4", "é", "_%"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert [(s.kind, s.start, s.end) for s in pii.base_spans(text)] == base_pii(text), text


def test_long_runs_stay_linear():
    for run in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1" + " " * 100_000):
        pii.base_spans(run)
        pii.candidates(run[:5000])
    start = time.perf_counter()
    for run in ("a" * 1_000_000, "1" * 1_000_000, "a@" * 300_000, "+1" + " " * 500_000, "1.2-3 " * 200_000, "a at b dot " * 100_000, ":a" * 300_000):
        pii.base_spans(run)
        pii.candidates(run)
    assert time.perf_counter() - start < 60


def test_many_spans_take_time_in_proportion(learnt):
    text = "\n".join(f"write to user{i} [at] mail{i % 9} [dot] org or u{i}@b.example.com" for i in range(20_000))
    start = time.perf_counter()
    found = pii.find_spans([text], learnt)[0]
    assert sum(s.base for s in found) == 20_000 and sum(not s.base for s in found) >= 18_000
    pii.examples(text)
    assert time.perf_counter() - start < 60


def test_trees_learn_an_exclusive_or():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = pii.boost(x, y)
    assert ((trees.margins(x) > 0) == (y == 1)).mean() > 0.97
    slope, shift = pii.calibrate(trees.margins(x), y)
    assert slope > 0 and pii.threshold(np.array([0.9, 0.8, 0.7, 0.6]), np.array([1, 1, 0, 0])) == pytest.approx(0.78)
    assert pii.threshold(np.array([0.9]), np.array([0])) == 2.0


@pytest.fixture(scope="module")
def learnt(spark):
    """A model learnt from the given documents."""
    return pii.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_unseen_dresses_are_found(learnt):
    rng = random.Random(12)
    names, hosts = ["ann", "bob.ray", "c_lee", "dora9"], ["mail", "post-box", "inbox"]

    def share(dress):
        texts = [dress(f"{rng.choice(names)}{i}", f"{rng.choice(hosts)}{i % 7}") for i in range(100)]
        return np.mean([any(s.kind == "email" and not s.base for s in f) for f in pii.find_spans(texts, learnt)])
    assert share(lambda a, h: f"you can reach {a} [at] {h} [dot] org any time") >= 0.9
    assert share(lambda a, h: f"write to {a} at {h} dot com please") >= 0.9
    assert share(lambda a, h: f"write to {a}é@{h}.org please") >= 0.9
    prose = ["we met at noon dot matrix printers were loud", "look at this dot and that", "the team at work dot dot dot", "stay at home dot"]
    assert not any(not s.base for f in pii.find_spans(prose, learnt) for s in f)


def test_registered_spans_keep_the_base(spark):
    """The contract's columns of the whole small table, against patterns run plainly."""
    got = {r.doc_id: r for r in pii.op2_pii(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base = base_pii(d.text or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))


def test_candidates_are_learnt_from_the_corpus(spark, odd):
    rng = random.Random(8)

    def card():
        body = [rng.randrange(10) for _ in range(15)]
        return next("".join(map(str, body)) + str(d) for d in range(10) if pii.luhn("".join(map(str, body)) + str(d)))
    texts = []
    for i in range(600):
        texts.append(rng.choice([
            f"write to user{i}@mail{i % 9}.example.com soon", f"host {rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)} up",
            f"card {card()} on file", f"call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} now",
            f"order {rng.randrange(10 ** 15, 10 ** 16)} of 2024-0{i % 9 + 1}-11 at 12.50", "plain words only here"]))
    docs = table(spark, [(t, "en", "s") for t in texts])
    model = pii.learn(docs)
    hard = ["write to user7 [at] mail3 [dot] example [dot] com soon", "card 4111.1111.1111.1111 ok", "we met 2024-01-15 at the dot market", "order 4111 1111 1111 1112"]
    found = pii.find_spans(hard, model)
    assert [[s.kind for s in f if not s.base] for f in found] == [["email"], ["card"], [], []]
    base = [pii.base_spans(t) for t in texts]
    assert all(set(b) <= set(f) for b, f in zip(base, pii.find_spans(texts, model)))
    assert pii.redacted("call +1 (659) 555-3949 now", pii.base_spans("call +1 (659) 555-3949 now")) == "call [PHONE] now"
    assert pii.redact(odd, model).columns == odd.columns and pii.redact(odd, model).count() == odd.count()
    assert pii.learn(odd.limit(0)).trees is None and pii.pii_spans(odd, pii.learn(odd)).count() == odd.count()


@pytest.mark.parametrize("kind, text, labels", [
    ("card", "paid by 4111.1111.1111.1111 today", {1}), ("card", "paid by 4111.1111.1111.1112 today", {0}),
    ("email", "write to bob [at] host [dot] com today", {1}), ("email", "we met at noon dot then left", set()),
    ("ip", "host 1[.]2[.]3[.]4 up", {1}), ("ip", "host 1[.]2[.]3[.]456 up", {0}), ("ip", "rows 1,2,3,4 only", set()),
    ("ip", "host 2001:db8::8:800:200c:417a up", {1}), ("ip", "came 12:30:45 here", {0}), ("phone", "order 12345 6789 0", set()),
    ("phone", "tel. 659 555 3949 now", set()), ("phone", "sum 659 555 3949 now", {0})])
def test_real_candidates_are_labelled_by_their_own_test(kind, text, labels):
    assert {y for k, _, y in pii.examples(text) if k == kind} == labels


def test_version_6_addresses_have_examples_of_both_classes():
    found = [(x, y) for i in range(20) for k, x, y in pii.examples(f"host 10.0.{i}.7 is up") if k == "ip"]
    colons = {y for x, y in found if x[13] >= 2}
    assert colons == {0, 1}


# ------------------------------------------------------------------ mixing

def plain_targets(sizes):
    """Water filling by repeated resharing."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if target[k] + share * weight[k] >= 3 * sizes[k]}
        for k in open_:
            step = min(share * weight[k], 3 * sizes[k] - target[k])
            target[k] += step
            left -= step
        open_ -= full
        if not full:
            break
    return target


def test_targets_and_schedule(spark):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        src = "hot" if i % 3 == 0 else rng.choice([None, "a", "B", "é", "tiny", "z"])
        rows.append((i, src, rng.randint(0, 60) if src != "tiny" else 1))
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    plan = mixing.schedule(sizes).collect()
    totals = Counter()
    for _, src, n in rows:
        totals[src] += n
    want, taken = plain_targets(totals), Counter()
    for r in plan:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= 60 for s in want) and sum(taken.values()) <= sum(totals.values())
    again = mixing.schedule(sizes.repartition(7)).collect()
    assert {r.doc_id: r.copies for r in plan} == {r.doc_id: r.copies for r in again}


def test_running_totals(spark):
    rows = [(i % 3 // 2, i * 7919 % 1000, i) for i in range(1000)]
    got = mixing.running(spark.createDataFrame(rows, "g int, o int, v int"), "t", [F.col("o"), F.col("v")], {"s": F.col("v")}, ("g",)).collect()
    want, seen = {}, Counter()
    for g, o, v in sorted(rows):
        seen[g] += v
        want[g, o, v] = seen[g]
    assert {(r.g, r.o, r.v): r.s for r in got} == want


def test_mix_of_odd_rows(spark, odd):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert mixing.mixed(odd.limit(0)).count() == 0 and mixing.mixed(odd.filter("doc_id = 1")).count() == 0
    per = Counter(r.doc_id for r in out.collect())
    assert max(per.values()) <= 6 and not {None, 1, 2, 5} & per.keys()
