"""Each corpus operator against brute force, and on awkward tables.

The awkward table has nulls in every column, empty, blank and long texts,
repeated rows and columns whose names clash with the operators' own.
"""

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexweave.llm import chat, components, decontaminate, langid, packing, runtime, sampling, simhash, substrings, topk, toxicity, urls, warc, words
from lexweave.llm.queries import URL_RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, id string, key int, slot int, rank int, component long"


def awkward(spark, texts=()):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = " ".join(rng.choice(words) for _ in range(120))
    long = " ".join(rng.choice(words) for _ in range(20_000))
    rows = [base, base, base + " tail more", None, "", " \t\n", "one", "One TWO", long, "x " * 90, "café ﬁ Σ", *texts]
    rows += [" ".join(rng.choice(words) for _ in range(60)) + " " + base[:300] for _ in range(4)]
    data = [(k, x, "en", "c", 1, 2, 3, 4) for k, x in enumerate(rows)]
    data += [data[0], data[0], (None, base, None, None, None, None, None, None), (None, "null id", None, None, None, None, None, None)]
    return spark.createDataFrame(data, DOCS)


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_simhash(spark):
    frame = awkward(spark)
    got = simhash.near_duplicates(frame)

    def fingerprint(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        n = min(3, len(words))
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    expected = Counter((i, fingerprint(t)) for i, t in rows_of(frame))
    found = got.collect()
    assert Counter((r.id, r.fingerprint % (1 << 64)) for r in found) == expected
    prints = sorted({p for _, p in expected})
    root = {p: p for p in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2 and root[a] != root[b]:
                old, new = root[a], root[b]
                root = {k: new if v == old else v for k, v in root.items()}
    for r in found:
        ids = [i for i, p in expected if root[p] == root[r.fingerprint % (1 << 64)] and i is not None]
        assert r.component == min(ids, default=None)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("bits", "limit"), [(2, 8192), (2, 4), (1, 2), (4, 8192)])
def test_links_keep_components(spark, bits, limit):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints |= {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, bits + 1))) for _ in range(30)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.fingerprint_links(frame, bits, limit).collect()]

    def classes(pairs):
        root = {p: p for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for p in prints:
            groups.setdefault(find(p), set()).add(p)
        return sorted(map(sorted, groups.values()))

    assert all((a ^ b).bit_count() <= bits for a, b in links)
    assert classes(links) == classes([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= bits])


def test_signatures(spark):
    """Near under any signature, against all pairs; unrelated texts stay apart."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = [(900, None), (901, ""), (902, " \t ")]
    for group in range(12):
        words = [word() for _ in range(150)]
        rows.append((10 * group, " ".join(words)))
        for copy in range(1, 5):
            words[rng.randrange(150)] = word()
            rows.append((10 * group + copy, " ".join(words)))
    rows += rows[:5]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(1))
    found = simhash.near_duplicates(frame, shingle=2, max_bits=5, signatures=3).collect()
    prints = {i: simhash._fingerprint((t or "").encode(), 2, 3) for i, t in rows}
    root = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if root[a] != root[b] and any((x ^ y).bit_count() <= 5 for x, y in zip(prints[a], prints[b], strict=True)):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    assert sorted((r.id, r.component) for r in found) == sorted((i, root[i]) for i, _ in rows)
    assert len(set(root.values())) == 13
    assert simhash.near_duplicates(frame.limit(0), signatures=2).count() == 0


def brute_repeats(rows, window=35):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    counts = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_substrings(spark):
    frame = awkward(spark, ["a b c d " * 40, " ".join(map(str, range(50))), "x " + " ".join(map(str, range(5, 50)))])
    got = substrings.remove_repeats(frame)
    assert Counter(tuple(r)[:4] for r in got.collect()) == brute_repeats(rows_of(frame))
    assert substrings.remove_repeats(frame.limit(0)).count() == 0


def test_frequent_passages(spark):
    """One passage in many documents of one chunk, so that its anchors are dealt out."""
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{'head ' * (k % 7)}h{k} {passage} t{k}") for k in range(60)]
    rows += [(100 + k, " ".join(f"w{k}x{j}" for j in range(80))) for k in range(5)] + [(200, "same " * 400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    salts, hot, drawn = substrings._salts(np.array([7, 3, 7, 7, 7, 3], np.uint64), np.zeros(0, np.uint64), 0)
    assert (salts.tolist(), hot.tolist(), drawn) == ([0, 0, 0, 1, 2, 0], [7], 2)
    assert substrings._salts(np.array([7, 4], np.uint64), hot, drawn)[0].tolist() == [3, 0]
    for batches in (1, 3):
        got = substrings.remove_repeats(frame, batches=batches)
        assert Counter(tuple(r)[:4] for r in got.collect()) == brute_repeats(rows)
    history = substrings.FingerprintIndex.create(spark, fanout=2)
    history.append(frame.where("doc_id < 40"), look=False)
    late = [r for r in rows if r[0] >= 40]
    got = substrings.remove_repeats(spark.createDataFrame(late, "doc_id long, text string"), index=history)
    expected = brute_repeats(rows)
    assert all(tuple(r)[:4] in expected for r in got.collect())


def test_index_is_reopened(spark):
    """Runs are merged, sorted by anchor, and found again by the manifest."""
    frame = awkward(spark)
    index = substrings.FingerprintIndex.create(spark, fanout=2, buckets=3)
    for k in range(3):
        index.append(frame.where(F.coalesce("doc_id", F.lit(0)) % 3 == k))
    assert [x.level for x in index.runs] == [1, 0]
    for run in index.runs:
        for files in run.files.values():
            for columns, _ in substrings.merged([f"{index.path}/{x}" for x in files], [False] * len(files)):
                assert (np.diff(columns[0]) >= 0).all()
    again = substrings.FingerprintIndex.open(spark, index.path)
    assert again == index
    flagged = {r.key for r in substrings.repeated_windows(frame, again, again.repeated().frame).collect()}
    texts = {t for i, t in rows_of(frame)}
    removed = {t for t in texts if any(n for (i, m, n, _), c in brute_repeats(rows_of(frame)).items() if (i, t) in rows_of(frame))}
    keys = {r.key: r.text for r in frame.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text").collect()}
    expected = {(i, n > 0) for i, _, n, _ in brute_repeats(rows_of(frame)) if n}
    assert {i for i, t in rows_of(frame) if t is not None and t in {keys[k] for k in flagged}} >= {i for i, _ in expected}
    assert {keys[k] for k in flagged} <= removed
    with pytest.raises(ValueError):
        substrings.FingerprintIndex.create(spark, window=100, gram=8)


def test_rows_that_share_an_id(spark):
    """Texts of one id, or of none, are told apart."""
    words = lambda n, m: " ".join(f"{n}x{k}" for k in range(m))
    rows = [(1, words("a", 40)), (1, words("b", 40)), (1, words("a", 40) + " tail"), (None, words("c", 50)), (None, words("c", 36)), (1, words("a", 40))]
    rows += [(7, f"{words(k, 20)} {words('z', 20)}") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r)[:4] for r in substrings.remove_repeats(frame).collect()) == brute_repeats(rows)


def test_removal_against_history(spark):
    """Each batch against itself and all before it; passages that batches share
    lie within different texts, so that their ranges end differently."""
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passages = [words(n) for n in (34, 35, 36, 50, 55, 60, 120)]
    batches = []
    for k in range(5):
        rows = [(100 * k + n, f"{words(rng.randrange(40))} {p} {words(rng.randrange(40))}") for n, p in enumerate(passages)]
        rows += [(100 * k + 50, words(90)), (100 * k + 51, None), (100 * k + 52, "few words")]
        batches.append(rows)
    batches[3] += [(None, passages[4] + " end"), batches[0][3]]
    index = substrings.FingerprintIndex.create(spark, fanout=3)
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        got = Counter(tuple(r)[:4] for r in substrings.remove_repeats(frame, index=index).collect())
        before = [r for batch in batches[:k] for r in batch]
        expected = brute_repeats(before + rows)
        ids = {i for i, _ in rows}
        assert {r: n for r, n in got.items()} == {r: sum(i == r[0] for i, _ in rows) for r in expected if r[0] in ids}
    assert len(index.runs) < 5


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words of 2,048 letters have one polynomial hash."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{word} {other} {word}".encode(), np.uint8)
    table = words.WordTable(data, np.array([0, len(data)]), words.BLANK_SEPARATED)
    for which in (0, 1):
        one, two, three = table._word_hashes(which).tolist()
        assert one == three != two
    assert (table.span_hashes(np.array([0]), np.array([1]), 1) != table.span_hashes(np.array([0]), np.array([1]))).all()
    from tokenizers import Tokenizer

    ids, bounds = packing.WordTokenizer(tokenizer_path()).encode(data, np.array([0, len(data)]))
    assert ids.tolist() == Tokenizer.from_file(tokenizer_path()).encode(data.tobytes().decode(), add_special_tokens=False).ids


def brute_tiles(pattern, text, least):
    """The longest unmarked match, the first of it, one after the other."""
    p, t, tiles = [False] * len(pattern), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for at in range(len(pattern)):
            for start in range(len(text)):
                n = 0
                while at + n < len(pattern) and start + n < len(text) and pattern[at + n] == text[start + n] and not p[at + n] and not t[start + n]:
                    n += 1
                if n > best[2]:
                    best = (at, start, n)
        at, start, n = best
        if n < least:
            return tiles
        tiles.append(best)
        p[at : at + n] = [True] * n
        t[start : start + n] = [True] * n


def test_tiles_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        pattern = [rng.randrange(4) for _ in range(rng.randint(0, 24))]
        text = [rng.randrange(4) for _ in range(rng.randint(0, 40))]
        assert decontaminate.greedy_tiles(pattern, text, 3, 99) == brute_tiles(pattern, text, 3)


def test_contamination_against_brute_force(spark):
    """Items against every document, with shuffled passages, repeats and nulls."""
    rng = random.Random(9)
    token = lambda: f"t{rng.randrange(60)}"
    items = [(k, " ".join(token() for _ in range(rng.randint(1, 14)))) for k in range(24)] + [(None, "t1 t2 t3 t4 t5 t6"), (50, ""), (51, None)]
    items += [items[0], items[20]]
    docs = [(k, " ".join(token() for _ in range(rng.randint(0, 60)))) for k in range(60)]
    for k in range(40):
        parts = items[rng.randrange(24)][1].split()
        cut = rng.randrange(len(parts))
        docs.append((100 + k, " ".join([token(), *parts[cut:], token(), *parts[:cut], token()])))
    docs += [(None, items[3][1]), (None, None), (7, "")]
    expected = Counter()
    for i, text in docs:
        for j, item in items:
            a, b = (item or "").split(), (text or "").split()
            if not a:
                continue
            tiles = brute_tiles(a, b, min(5, len(a)))
            tiles = [x for x in tiles if len(a) >= 5 or x[2] == len(a)][: None if len(a) >= 5 else 1]
            covered = sum(n for _, _, n in tiles)
            if covered >= 0.5 * len(a):
                expected[(i, j, covered, len(tiles))] += 1
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (2_000_000, 20):
        got = Counter((r.id, r.item, r.covered, r.tiles) for r in decontaminate.contaminated_pairs(d, b, block_tokens=block).collect())
        assert got == expected
    gone = {(i, t) for i, t in docs for e in expected if e[0] == i}
    kept = Counter(rows_of(decontaminate.without_contaminated(d, b)))
    assert sum(kept.values()) == len(docs) - len({id(x) for x in docs if any(e[0] == x[0] for e in expected) and (x[1] or "").strip()}) and gone


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    first, second = " ".join(item.split()[:10]), " ".join(item.split()[10:])
    bench = spark.createDataFrame([(1, item), (2, None), (3, "two short"), (4, "other words that never occur in any of the documents here")], "item_id long, text string")
    frame = awkward(spark, ["noise " + item.upper() + " noise", f"{second}, and then {first}.", " ".join(item.split()[:6])])
    texts = dict(rows_of(frame.where("text ilike '%alpha%' or text ilike '%lambda%'")))
    got = {(r.id, r.item): (r.covered, r.tiles) for r in decontaminate.contaminated_pairs(frame, bench).collect()}
    ids = sorted(texts)
    assert got == {(ids[0], 1): (20, 1), (ids[1], 1): (20, 2)}
    small = {(r.id, r.item): (r.covered, r.tiles) for r in decontaminate.contaminated_pairs(frame, bench, block_tokens=10).collect()}
    assert small == got
    kept = decontaminate.without_contaminated(frame, bench)
    assert kept.columns == frame.columns and kept.count() == frame.count() - 2
    assert decontaminate.contaminated_pairs(frame, bench.limit(0)).count() == decontaminate.contaminated_pairs(frame.limit(0), bench).count() == 0


def test_tiles_are_greedy():
    tiles = decontaminate.greedy_tiles([1, 2, 3, 4, 5, 6], [4, 5, 6, 99, 1, 2, 3, 4], 2, 4)
    assert tiles == [(0, 4, 4), (4, 1, 2)]


def test_packing(spark):
    from tokenizers import Tokenizer

    frame = awkward(spark, ["<|endoftext|> it's", "a\x1cb　c\u00a0d İx"])
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(frame, tokenizer_path()).collect()
    ids = {t: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows_of(frame)}
    expected, texts = Counter(), Counter((i, len(ids[t])) for i, t in rows_of(frame))
    for (i, _), t in zip(rows_of(frame), [t for _, t in rows_of(frame)], strict=True):
        for start, size in packing._cuts(len(ids[t]), 2048):
            expected[(i, start, size, zlib.crc32(np.array(ids[t][start : start + size], "<u4").tobytes()), len(ids[t]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == expected and texts
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 2048
    assert packing.pack(frame.limit(0), tokenizer_path()).count() == 0


def test_packing_plan_covers_demand():
    rng = random.Random(1)
    demand = Counter(rng.randint(1, 128) for _ in range(3000))
    plan = packing.packing_plan(dict(demand), 256)
    made = Counter()
    for pattern, use in plan:
        assert sum(k * n for k, n in pattern.items()) <= 256
        made.update({k: n * use for k, n in pattern.items()})
    assert made == demand
    assert sum(use for _, use in plan) <= 1.01 * sum(k * n for k, n in demand.items()) / 256 + 1


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://b/\r\nx", None), (4, "u", ""), (5, "u", "été" * 50_000), (None, "n", "same"), (None, "n", "alone"), (2, None, "same")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, payload string")
    read = warc.read_archives(warc.archive_pages(spark, pages)).collect()
    assert len(read) == len(rows) and all(r.verified for r in read)
    found = Counter((r.id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in read)
    name = lambda k: f"urn:page:{'null' if k is None else k}"
    expected = Counter()
    for k, _, html in rows:
        payload = (html or "").encode()
        group = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        last = max(group, default=None)
        expected[(name(k), len(payload), warc.base32_sha1(payload), "response" if last is None or k == last else "revisit", None if last is None or k == last else name(last))] += 1
    assert found == expected
    assert warc.read_archives(warc.archive_pages(spark, pages.limit(0))).count() == 0


def test_warc_salvage():
    plain = [warc.record("response", f"urn:{k}", "http://x/", b"payload %d" % k * 50, warc.base32_sha1(b"payload %d" % k * 50)) for k in range(4)]
    members = [warc.member(x) for x in plain]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    data = members[0] + bytes(broken) + members[2] + b"junk" + plain[3] + members[3][: len(members[3]) // 2]
    items = list(warc.SalvageReader(io.BytesIO(data), step=97))
    good = [x.headers["warc-record-id"] for x in items if x.reason is None]
    gaps = [(x.start, x.end) for x in items if x.reason is not None]
    assert good == ["<urn:0>", "<urn:2>", "<urn:3>"]
    a, b, c = len(members[0]), len(members[0]) + len(broken), len(members[0]) + len(broken) + len(members[2])
    assert gaps == [(a, b), (c, c + 4), (c + 4 + len(plain[3]), len(data))]
    assert gzip.decompress(members[0]) == plain[0]
    # A member of three records with a bad one among them, and one that is cut off.
    bad = plain[1].replace(b"payload 1", b"PAYLOAD 1", 1)
    whole = warc.member(plain[0] + bad + plain[2])
    items = list(warc.SalvageReader(io.BytesIO(whole + members[3]), step=50))
    assert [x.headers.get("warc-record-id") for x in items] == ["<urn:0>", None, "<urn:2>", "<urn:3>"]
    gap = items[1]
    assert (gap.start, gap.reason, gap.inner, gap.inner_end) == (0, "digest mismatch", len(plain[0]), len(plain[0] + bad)) and items[2].end == len(whole)
    rng = np.random.default_rng(3)
    noise = [warc.record("response", f"urn:n{k}", "http://x/", x, warc.base32_sha1(x)) for k, x in enumerate(rng.bytes(4000) for _ in range(4))]
    cut = warc.member(b"".join(noise))[:13_000]
    items = list(warc.SalvageReader(io.BytesIO(cut + members[3] + plain[2])))
    good = [x.headers["warc-record-id"] for x in items if x.reason is None]
    assert good == ["<urn:n0>", "<urn:n1>", "<urn:3>", "<urn:2>"][: 2 if len(good) == 4 else 3][:2] + good[2:] and good[-2:] == ["<urn:3>", "<urn:2>"] and "<urn:n1>" in good
    (lost,) = [x for x in items if x.reason is not None]
    assert (lost.start, lost.end) == (0, len(cut)) and lost.inner >= len(noise[0])
    assert [x.reason for x in warc.SalvageReader(io.BytesIO(plain[0]), limit=10)] == ["block over the limit"]
    assert list(warc.SalvageReader(io.BytesIO(b""))) == []
    bad = plain[0].replace(b"payload 0", b"PAYLOAD 0", 1)
    assert [x.reason for x in warc.SalvageReader(io.BytesIO(bad + plain[1]))] == ["digest mismatch", None]


def test_toxicity(spark):
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice(["house", "garden", "river", "stone", "paper", "green", "slow", "walk"]) for _ in range(60))
    texts = [(plain(), 0) for _ in range(80)] + [(plain() + " you are an idiot and a moron " + plain(), 1) for _ in range(40)]
    model = toxicity.fit_toxicity(spark.createDataFrame(texts, "text string, toxic int"))
    frame = awkward(spark, ["you are such an idi0t, a morron " + plain(), plain()])
    got = {(r.id, round(r.score, 6)) for r in toxicity.score_toxicity(frame, model).collect()}
    assert toxicity.score_toxicity(frame, model).count() == frame.count() and all(0 <= s <= 1 for _, s in got)
    scores = dict(got)
    assert scores[11] >= 0.3 > scores[12]
    one = toxicity.fit_toxicity(spark.createDataFrame(texts[:5], "text string, toxic int"))
    assert toxicity.score_toxicity(frame.limit(0), one).count() == 0


def test_automaton_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    terms = {"ab": 0, "abcd": 1, "abce": 1, "dcbaabcd": 2}
    automaton = toxicity.LexiconAutomaton(terms)
    rng = random.Random(4)
    for _ in range(4000):
        word = "".join(rng.choice("abcdez") for _ in range(rng.randint(0, 10)))
        best = min(((distance(word, t), t) for t, k in terms.items() if distance(word, t) <= k), default=None)
        assert automaton.match(word) == (best and (best[1], best[0]))


def test_topk(spark):
    rng = np.random.default_rng(0)
    vectors = [(int(k), [float(x) for x in rng.normal(size=8)]) for k in range(300)]
    vectors += [(300, vectors[20][1]), (20, vectors[20][1]), (301, None), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8), (305, []), (306, [2.0] * 3)]
    frame = spark.createDataFrame([(*v, 1, 2) for v in vectors], "vec_id long, embedding array<float>, id int, score int")
    whole = {}
    for k, (i, v) in enumerate(vectors):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            whole[k] = (i, np.pad(np.floor(64 * np.array(v, np.float32).astype(float)), (0, 8 - len(v))))
    for top in (5, 1000):
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(frame, F.col("id") % 20 == 0, k=top).collect()}
        expected = {}
        for q, x in {i: x for i, x in whole.values() if i % 20 == 0}.items():
            best = sorted(((-int(x @ y), i) for i, y in whole.values() if i != q))[:top]
            expected |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
        assert got == expected
    assert topk.top_k(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_language(spark):
    words = {"en": "the of and that with house from this", "de": "der und nicht das ist haus von mit", "fr": "le la les des est maison avec dans"}
    rng = random.Random(6)
    texts = [(" ".join(rng.choice(words[lang].split()) for _ in range(40)), lang) for lang in words for _ in range(30)]
    labelled = spark.createDataFrame(texts, "text string, lang string")
    model = langid.fit_centroids(labelled.where("length(text) > 0"))
    held = spark.createDataFrame([(" ".join(rng.choice(words[lang].split()) for _ in range(12)), lang) for lang in words for _ in range(10)], "text string, lang string")
    assert held.count() == langid.identify(held, model).where("lang = lang_pred and not lang_rejected").count()
    frame = awkward(spark, ["1234 !!", "the of and"])
    got = {(r.doc_id, r.lang_pred, r.lang_rejected) for r in langid.identify(frame, model).collect()}
    assert {(k, "und", True) for k in (3, 4, 5, 11)} <= got and (12, "en", False) in got
    assert langid.identify(frame, model).count() == frame.count()
    empty = langid.fit_centroids(labelled.limit(0))
    assert {r.lang_pred for r in langid.identify(frame, empty).collect()} == {"und"}
    assert langid.identify(frame.limit(0), model).count() == 0


def test_urls(spark):
    bad = [f"http://casino-win{k}.xx{k % 3}.biz/a/{k}?q=1&r=2" for k in range(60)]
    good = [f"https://news.example{k}.org/story/{k}" for k in range(60)]
    model = urls.fit_url_model(spark.createDataFrame([(u, 1.0) for u in bad] + [(u, 0.0) for u in good], "url string, label double"))
    cases = {
        "http://a.com": (None, "a.com", ""),
        "http://A.COM/x": ("com/", "a.com", "/x"),
        "http://example.com/en/1": ("example.com/en/", "example.com", "/en/1"),
        "http://www.Example.com/en/?a": ("www.example.com/en/", "www.example.com", "/en/"),
        "http://notexample.com/en/": ("com/", "notexample.com", "/en/"),
        "https://x.net/fr/1#b": ("net/fr/", "x.net", "/fr/1"),
        "ftp://h?x://y/z": (None, "h", ""),
        "nothing": (None, "", ""),
        "": (None, "", ""),
        None: (None, "", ""),
        bad[0]: (None, "casino-win0.xx0.biz", "/a/0"),
        good[0]: (None, "news.example0.org", "/story/0"),
    }
    frame = spark.createDataFrame([(k, u, "h", "p", 1.0) for k, u in enumerate(cases)] + [(None, None, None, None, None)], "page_id long, url string, host string, path string, score double")
    rows = {r.id: r for r in urls.filter_urls(frame, model, URL_RULES).collect()}
    for k, (rule, host, path) in enumerate(cases.values()):
        assert (rows[k].rule, rows[k].host, rows[k].path) == (rule, host, path)
    last = len(cases)
    assert rows[last - 2].verdict == "block" and rows[last - 1].verdict == "allow" and rows[None].verdict == "allow"
    assert len({r.score for r in rows.values()}) > 2 and set(urls.lexical_features(F.col("url"), F.col("host"), F.col("path"))) == set(urls.FEATURES)
    labels = Counter((r.url, r.label) for r in urls.labelled_urls(frame, URL_RULES).collect())
    assert labels == Counter({("http://A.COM/x", 0.0): 1, ("http://example.com/en/1", 1.0): 1, ("http://www.Example.com/en/?a", 0.0): 1, ("http://notexample.com/en/", 0.0): 1, ("https://x.net/fr/1#b", 1.0): 1, (bad[0], 1.0): 1})
    one = urls.fit_url_model(urls.labelled_urls(frame.limit(0), URL_RULES))
    assert urls.filter_urls(frame.limit(0), one, URL_RULES).count() == 0


def test_tool_calls(spark):
    schema = {"add": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}}, "required": ["a"], "additionalProperties": False}}
    calls = [(1, 0, "c1", "add", '{"b": 2.5, "a": 1}', []), (1, 1, "c2", "add", '{"a": -1, "z": 0}', ["c1"]), (1, 2, "c3", "none", "{}", ["c2", "c1"]), (1, 3, "c4", "add", "not json", ["c5"]), (1, 3, "c5", "add", None, ["c4"]), (1, 9, "c1", "add", "{}", []), (None, 0, "c1", "add", "{}", []), (2, 0, None, "add", "{}", []), (2, 5, "c1", "add", '{"a": true}', ["gone"])]
    results = [(1, 4, "c1", "é"), (1, 5, "c1", "again"), (1, 4, "c9", None), (2, 1, "c1", "early")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    got = {(x.conv_id, x.call_id): x for x in chat.link_calls(c, r, schema).collect()}
    state = {k: (x.status, x.level, x.valid, x.n_calls, x.n_results) for k, x in got.items()}
    assert state == {
        (1, "c1"): ("linked", 0, True, 2, 2),
        (1, "c2"): ("unanswered", 1, False, 1, 0),
        (1, "c3"): ("unanswered", 2, False, 1, 0),
        (1, "c4"): ("cyclic", None, False, 1, 0),
        (1, "c5"): ("cyclic", None, False, 1, 0),
        (1, "c9"): ("orphan", None, False, 0, 1),
        (2, "c1"): ("early", 0, False, 1, 1),
    }
    assert got[(1, "c1")].json == '{"arguments":{"a":1,"b":2.5},"id":"c1","name":"add","result":"é"}'
    assert got[(1, "c2")].errors == ["$.a: range", "$.z: unknown"]
    assert chat.link_calls(c.limit(0), r.limit(0), schema).count() == 0
    messages = spark.createDataFrame([(1, 0, "assistant", '{"tool_calls":[{"id":"k","name":"add","arguments":{"a":3}}]}'), (1, 1, "tool", '{"tool_call_id":"k","content":"3"}'), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    (x,) = chat.link_calls(*chat.parse_messages(messages), schema).collect()
    assert (x.status, x.valid, x.json) == ("linked", True, '{"arguments":{"a":3},"id":"k","name":"add","result":"3"}')


def test_url_features_against_plain_code(spark):
    import math

    cases = ["http://a-b.c1.org/x/yy/3?p=1&q=2#f", "https://xx.net", "ftp://É.com//", "http://h" + "o" * 3000 + ".biz/" + "9" * 2000, "http://h" + "o" * 3000 + ".biz/" + "9" * 2000]
    host, path = urls.host_and_path(F.col("url"))
    rows = spark.createDataFrame([(x,) for x in cases], "url string").withColumn("host", host).withColumn("path", path)
    found = rows.select("host", "path", *[c.alias(n) for n, c in urls.lexical_features(F.col("url"), F.col("host"), F.col("path")).items()]).collect()

    def entropy(x):
        return -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values()) if x else 0.0

    for url, r in zip(cases, found, strict=True):
        h, p = r.host, r.path
        assert (r.url_length, r.host_length, r.path_length, r.depth, r.labels, r.hyphens) == (len(url), len(h), len(p), p.count("/"), h.count("."), h.count("-"))
        assert (r.parameters, r.fragment, r.secure, r.longest_label) == ((url.count("&") + url.count("=")) / 2, url.count("#"), float(url.startswith("https")), max(map(len, h.split("."))))
        assert r.host_digits == pytest.approx(sum(c.isdigit() for c in h) / max(1, len(h))) and r.vowels == pytest.approx(sum(c in "aeiou" for c in h) / max(1, len(h)))
        assert r.host_entropy == pytest.approx(entropy(h)) and r.path_entropy == pytest.approx(entropy("".join("0" if c in "0123456789" else c for c in p)))


def test_url_trees_against_a_plain_sum(spark):
    """Scores are the logistic of twice the trees' weighted sum; urls of a fold
    that the trees have not seen are told apart."""
    pages = spark.createDataFrame([(f"http://{'www.' * (k % 2)}{'win-' if k % 3 == 0 else ''}h{k % 40}.{('com', 'net', 'org')[k % 5 % 3]}/{('en', 'fr')[k % 2]}/{k}",) for k in range(600)] + [("http://h1.com/x",)] * 3, "url string")
    labelled = urls.labelled_urls(pages, URL_RULES)
    model = urls.fit_url_model(labelled.where("crc32(cast(url as binary)) % 4 <> 2"))
    host, path = urls.host_and_path(F.col("url"))
    rows = labelled.where("crc32(cast(url as binary)) % 4 = 2").withColumn("host", host).withColumn("path", path)
    scored = model.scored(rows).collect()
    ones, zeros = [r.score for r in scored if r.label == 1], [r.score for r in scored if r.label == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert auc > 0.9
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=urls._NAMES, outputCol="v").transform(urls._with_features(rows, model.counts, model.rate)).select("url", "v").collect()
    score = {r.url: r.score for r in scored}
    for r in vectors:
        margin = sum(w * tree.predict(r.v) for w, tree in zip(model.trees.treeWeights, model.trees.trees, strict=True))
        assert score[r.url] == pytest.approx(1 / (1 + np.exp(-2 * margin)))


def test_language_against_plain_cosine(spark):
    """The nearest centroid by cosine, counted n-gram by n-gram."""
    rng = random.Random(1)
    vocabulary = {"aa": "abcde", "bb": "defgh", "cc": "ghijé"}
    text = lambda lang, n: " ".join("".join(rng.choices(vocabulary[lang], k=4)) for _ in range(n))
    labelled = spark.createDataFrame([(k, text(lang, 30), lang) for k in range(30) for lang in vocabulary], "doc_id long, text string, lang string")
    model = langid.fit_centroids(labelled, per_language=20, centroids=2)
    assert len(model.centres) == 6
    held = [text(lang, n) for lang in vocabulary for n in (1, 3, 40)] + [text("aa", 20) + " " + text("bb", 21), "Éé 12", "!!"]

    def plain(t):
        letters = "".join(c if c.isalpha() else " " for c in t.lower())
        if not letters.strip():
            return "und", 0.0
        padded = " " + "".join(c for k, c in enumerate(letters) if c != " " or (k and letters[k - 1] != " ")) + " "
        counts = Counter()
        for size in (1, 2, 3):
            for k in range(len(padded) - size + 1):
                one = [ord(c) for c in padded[k : k + size]]
                h = one[0] * 2654435761
                if size > 1:
                    h = ((h & 0xFFFFFFFF) ^ (one[1] * 2246822519 & 0xFFFFFFFF)) * 3266489917
                if size > 2:
                    h = ((h & 0xFFFFFFFF) ^ (one[2] * 668265263 & 0xFFFFFFFF)) * 374761393
                counts[(h & 0xFFFFFFFF) >> 19] += 1
        vector = {b: np.log1p(n) * model.idf[b] for b, n in counts.items()}
        norm = np.sqrt(sum(x * x for x in vector.values()))
        cosines = [sum(x * centre[b] for b, x in vector.items()) / norm for centre in model.centres]
        best = int(np.argmax(cosines))
        return model.languages[model.owner[best]], cosines[best]

    found = langid.identify(spark.createDataFrame([(t,) for t in held], "text string"), model).collect()
    for t, r in zip(held, found, strict=True):
        language, score = plain(t)
        assert r.lang_pred == language and r.lang_score == pytest.approx(score, abs=1e-4)


def test_toxicity_against_plain_counts(spark):
    """Counts and scores of whole texts, word by word with every term."""
    model = toxicity.ToxicityModel(toxicity.Lexicon({"idiot": 1.0, "idiom": 0.5, "scum": 1.0}, {"vermi": 1.0}, frozenset({"idyot"})), np.array([-2.0, 1, 2, 0.5, 0.25, 1]))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    def weight(word):
        lexicon = model.lexicon
        if word in lexicon.terms:
            return lexicon.terms[word]
        if word[:5] in lexicon.stems:
            return 1.0
        near = min(((distance(word.translate(toxicity.LEET), t), t) for t in lexicon.terms if distance(word.translate(toxicity.LEET), t) <= toxicity.edit_limit(t)), default=None)
        return 0.0 if near is None or word in lexicon.clean else lexicon.terms[near[1]] * 0.8 ** near[0]

    texts = ["you idiot", "idio", "the man said \"idiot\" today", "an idi0t, vermin and scvm", "idyot", "", None, "plain words only", "far " * 30 + "idiot " + "far " * 30]
    kinds = {0: "aimed", 2: "quoted"}
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "you idiot"), (0, "you idiot")], "doc_id long, text string")
    rows = toxicity.score_toxicity(frame, model).collect()
    found = {r.id: r.score for r in rows}
    for k, t in enumerate(texts):
        tokens = [x.strip("\",") for x in (t or "").split()]
        total = sum(map(weight, tokens))
        direct, quoted = (0.0, total) if kinds.get(k) == "quoted" else (total, 0.0)
        aimed = total if kinds.get(k) == "aimed" else 0.0
        row = [1, min(direct, 1), np.log1p(direct), np.log1p(100 * direct / max(len(tokens), 1)), np.log1p(quoted) * (direct == 0), np.log1p(aimed)]
        assert found[k] == pytest.approx(1 / (1 + np.exp(-np.dot(row, model.beta))))
    assert found[None] == found[0] and len(rows) == len(texts) + 2 and [r.score for r in rows if r.id == 0] == [found[0]] * 2


def test_samples_are_bounded(spark):
    """20,000 copies of one row, or of one text, exceed no bound."""
    rows = [(5, "copy", 1)] * 20_000 + [(k, "copied text", 1) for k in range(10_000)] + [(k, f"text {k}", k % 2) for k in range(3000)] + [(1, None, 1), (2, "x", None)]
    frame = sampling.placed(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    sample, sizes = sampling.class_sample(frame, frame, "label", "text", 200)
    assert sizes == {0: 1500, 1: 31_500}
    assert Counter(x for x, _, _ in sample) == {0: 200, 1: 200} and all(n == (20_000 if t == "copy" else 1) for _, t, n in sample)
    assert sampling.class_sample(frame, frame, "label", "text", 200) == (sample, sizes)
    small, _ = sampling.class_sample(frame, frame, "label", "text", 200, class_bytes=50)
    assert all(sum(len(t) for x, t, _ in small if x == label) <= 50 for label in (0, 1)) and small
    labelled = spark.createDataFrame([(f"http://a{k % 30}.com/", float(k % 2)) for k in range(3000)], "url string, label double")
    assert urls.fit_url_model(labelled, per_class=10).trees is not None


def test_components(spark):
    """One task and star rounds agree with a plain search."""
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + k) for k in range(50)] + [(-5, 7), (-5, -(1 << 63)), (3, 3), (1000, 1001)]
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    expected = {(x, r) for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    frame = spark.createDataFrame(edges, "a long, b long")
    for limit in (1 << 20, 7):
        assert {tuple(r) for r in components.connected_components(frame, task_edges=limit).collect()} == expected
    assert components.connected_components(frame.limit(0)).count() == 0


def test_written_tables(spark):
    """Nulls, nested values, names and empty tables come back as they were."""
    frame = spark.createDataFrame([(1, "a", [1, None], (2, "x"), b"\0"), (None, None, None, None, None)], "k long, t string, l array<int>, s struct<a:int, b:string>, y binary")
    table = runtime.stored(frame.withColumn("at", F.timestamp_seconds(F.col("k"))), "round-trip")
    assert sorted(map(str, table.frame.collect())) == sorted(map(str, frame.withColumn("at", F.timestamp_seconds(F.col("k"))).collect())) and table.rows == 2
    empty = runtime.stored(frame.limit(0), "round-trip")
    assert empty.frame.schema == frame.schema and empty.rows == 0 == empty.frame.count()
    table.drop()


def test_tool_call_levels(spark):
    """Chains, forks and cycles against a plain search; a long conversation."""
    rng = random.Random(12)
    calls = [(1, k, f"c{k}", "t", "{}", [f"c{k - 1}"]) for k in range(200)]
    calls += [(2, k, f"c{k}", "t", "{}", [f"c{rng.randrange(60)}" for _ in range(rng.randint(0, 3)) if k] if k % 3 else [f"c{k - 1}"]) for k in range(40)]
    calls += [(3, 0, "a", "t", "{}", ["a"]), (3, 1, "b", "t", "{}", ["a", "c"]), (3, 2, "c", "t", "{}", None), (3, 3, "d", "t", "{}", ["b"])]
    frame = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    known = {(c, i): [(c, x) for x in dict.fromkeys(after or []) if any(y[0] == c and y[2] == x for y in calls)] for c, _, i, _, _, after in calls}
    level: dict = {}
    for _ in range(250):
        for call, needs in known.items():
            if call not in level and all(x in level for x in needs):
                level[call] = max((level[x] + 1 for x in needs), default=0)
    got = {(r.conv_id, r.call_id): r.level for r in chat.link_calls(frame, frame.select("conv_id", "turn", "call_id", F.lit("").alias("content")).limit(0), {"t": {}}).collect()}
    assert got == {call: level.get(call) for call in known}


def test_tool_calls_awkward(spark):
    """Clashing columns, long texts and rows that are repeated as a whole."""
    long = "word " * 100_000
    turns = [(1, 0, "system", long), (1, 1, "user", "q"), (1, 2, "assistant", long), (1, 3, "user", None), (2, 0, "user", "alone"), (None, 0, "user", "x"), (3, None, "user", "x"), (4, 1, "assistant", "late")]
    frame = spark.createDataFrame([(*x, "c", "n", 1) for x in turns + turns], "conv_id long, turn long, role string, text string, call_id string, name string, level int")
    got = {(r.conv_id, r.call_id): (r.name, r.status, r.level, r.n_calls, r.n_results, r.valid) for r in chat.link_calls(*chat.exchanges(frame), chat.EXCHANGE_SCHEMAS).collect()}
    assert got == {
        (1, "turn-0"): ("setup", "unanswered", 0, 2, 0, False),
        (1, "turn-1"): ("reply", "linked", 1, 2, 2, True),
        (1, "turn-3"): ("reply", "unanswered", 2, 2, 0, False),
        (2, "turn-0"): ("reply", "unanswered", 0, 2, 0, True),
        (4, "turn-0"): (None, "orphan", None, 0, 2, False),
    }


def test_topk_ids_and_bounds(spark):
    """Ids near 2**63 and of other kinds; bounds skip candidates without loss."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 10
    vectors = [((1 << 63) - 1 - 20 * k, [float(x) for x in centres[k % 6] + 0.1 * rng.normal(size=8)]) for k in range(3000)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    asked = F.col("id") % 77 == 0
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(frame, asked, k=3).collect()}
    x = np.floor(64 * np.array([v for _, v in vectors], np.float32).astype(float))
    ids = np.array([i for i, _ in vectors])
    expected = {}
    for q in np.flatnonzero(ids % 77 == 0):
        scores = x @ x[q]
        best = sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != ids[q])[:3]
        expected |= {(int(ids[q]), n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == expected
    evaluated, met = topk.evaluated_share(frame, asked, k=3)
    assert met == len({q for q, _ in expected}) * (len(vectors) - 1) and evaluated < 0.6 * met
    with pytest.raises(ValueError, match="integer"):
        topk.top_k(frame.withColumn("vec_id", F.col("vec_id").cast("string")), asked)


def test_topk_of_copies_is_not_broadcast(spark):
    """Blocks of copies compress to small files, but are not small in memory."""
    vectors = [(i, [float((i % 3 + k) % 5) / 8 for k in range(16)]) for i in range(600)]
    found = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0, k=4)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in found.collect()}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    x = np.floor(64 * np.array([v for _, v in vectors], np.float32).astype(float))
    best = {q: sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:4] for q in range(0, 600, 20)}
    assert got == {(q, n): (i, -s) for q, rows in best.items() for n, (s, i) in enumerate(rows, 1)}


def test_near_copies_of_a_large_group(spark):
    """A group that is dealt out in parts keeps one text of its copies."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for k in range(150):
        own = list(base)
        own[rng.randrange(120)] = f"x{k}"
        rows.append((1, k, k, 800, " ".join(own)))
    rows += [(1, 200 + k, 200 + k, 800, " ".join(f"y{k}x{j}" for j in range(120))) for k in range(40)]
    frame = spark.createDataFrame(rows, "group long, id long, hash long, size long, text string")
    whole = {r.hash for r in simhash.similar_heads(frame, frame.select("id", "hash", "text")).collect()}
    parts = {r.hash for r in simhash.similar_heads(frame, frame.select("id", "hash", "text"), part_bytes=16_000).collect()}
    assert whole == parts == {0, *range(200, 240)}


def test_parts_of_a_large_group_lose_no_link(spark):
    """Chains whose neighbours alone are similar give what one part gives."""
    rows = []
    for chain in range(24):
        words = [f"c{chain}w{k}" for k in range(140)]
        # Windows that move by 5 words: next ones have a similarity of 91 / 101, those three apart one of 81 / 111.
        for k in range(8):
            rows.append((1 + chain % 2, 100 * chain + (k * 5) % 8, 1000 * chain + k, 700, " ".join(words[5 * k : 5 * k + 100])))
    rows += [(1, None, -5, 700, "one two"), (1, 7_000, -6, 700, ""), (1, 7_001, -7, 700, None)]
    frame = spark.createDataFrame(rows, "group long, id long, hash long, size long, text string")
    texts = frame.select("id", "hash", "text")
    expected = sorted([*(1000 * chain for chain in range(24)), -5, -6])
    for part_bytes in (8 << 20, 40_000, 12_000):
        assert sorted(r.hash for r in simhash.similar_heads(frame, texts, part_bytes=part_bytes).collect()) == expected, part_bytes
