"""Each operator against a plain version of its contract, on small fixtures with all edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import types as T

from provspark.llm import classifier, decontamination, language_id, line_dedup, mixing, near_dup, quality_rules, queries, substring_dedup, tokens, url_filter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        T.StructField("size", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)
SYLLABLES = "the re on tion an er ing ed ou ha le ne ça über straße ñandú".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def prose(rng, n):
    out = []
    for i in range(n):
        w = word(rng)
        out.append(w.capitalize() if i % 9 == 0 else w)
        out.append(".\n" if i % 9 == 8 else " ")
    return "".join(out)


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text, lang, source) with copies, near copies, shared passages, nulls and blanks."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(40)]
    shared = prose(rng, 40)
    rows = []
    for i, t in enumerate(base):
        rows.append((t, "en" if i % 2 else "de", f"s{i % 4}"))
    for i in range(20):
        t = base[i]
        rows.append((t, "en", "s0"))
        rows.append((t[: len(t) // 2] + " changed " + t[len(t) // 2 :], "de", "s1"))
        rows.append((prose(rng, 12) + shared + prose(rng, 7), "en", "s0"))
        rows.append((base[i] + "\n" + shared, None, None))
    rows += [(None, "en", "s2"), ("", "en", "s0"), (" \n\t ", "de", None), ("a", "en", "s9"), ("1234 *** 5", "de", "s0"), ("a b", "en", "s0")]
    rows += [("The cat SAT ", "en", "s1"), ("the cat sat", "en", "s1"), ("aaaa " * 400, "en", "s0"), ("x" * 3000, "de", "s0"), (prose(rng, 4000), "en", "s3")]
    rng.shuffle(rows)
    return [(3 * i + 1, *r) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, lang, s, None if t is None else len(t), "x", "x", "x", "x") for i, t, lang, s in texts]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def rows_by_id(df):
    out = {r["doc_id"]: r for r in df.collect()}
    return out


def test_mixing(docs, texts, nothing):
    got = rows_by_id(mixing.mix_sources(docs))
    size = {i: len(SPACE_WORD.findall(t or "")) for i, t, _, _ in texts}
    of = {i: s for i, _, _, s in texts}
    total = defaultdict(int)
    for i, s in of.items():
        total[s] += size[i]
    order = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    # reshare until none is above
    target, capped = {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * total[s] if s in capped else left * weight[s] / w for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    assert len(got) == len(texts)
    for s in order:
        mine = [r for r in got.values() if r["source"] == s]
        assert {r["source_size"] for r in mine} == {total[s]}
        assert all(abs(r["target"] - target[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max(r["size"] for r in mine) / 2 + 1e-6
    assert all(r["size"] == size[i] and 0 <= r["taken"] <= 3 * r["size"] for i, r in got.items())
    again = rows_by_id(mixing.mix_sources(docs.repartition(3)))
    assert {i: r["taken"] for i, r in again.items()} == {i: r["taken"] for i, r in got.items()}
    assert mixing.mix_sources(nothing).count() == 0


def test_tokens(spark, docs, texts, nothing, tmp_path):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = rows_by_id(tokens.count_tokens(docs, path, cache, limit=100))
        for i, t, _, _ in texts:
            n = len(model.encode(t or ""))
            assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, _, _ in texts})
    assert tokens.count_tokens(nothing, path).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  ", "a", " a", "a ", "a  b", "a   ", "\n", " \n b", "a\nb", "▁", "a▁ b", "<s>", "</s> <unk>", "é é\u00a0x", "  a  b  ", "🙂 x"])
def test_tokens_by_chunk(text):
    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        c = tokens.PieceCounter(f.read())
    assert c.by_chunk
    assert c.count([text]) == [len(c.model.encode(text))]


def test_json_tokenizer(docs, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    got = rows_by_id(tokens.count_tokens(docs, path))
    for i, t, _, _ in texts[:30]:
        assert got[i]["n_tokens"] == len(model.encode(t or "", add_special_tokens=False).ids)


def test_quality_base_counts(docs, texts, nothing):
    got = rows_by_id(quality_rules.quality_rules(docs))
    for i, t, _, _ in texts:
        words = SPACE_WORD.findall(t or "")
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {k for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for k in range(j, j + 3)}
        lines, dup, seen = (t or "").split("\n"), 0, set()
        for x in lines:
            if SPACE_WORD.search(x):
                dup += x in seen
                seen.add(x)
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        want = (len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(hit), failed)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (failed and r["kept"])
    assert quality_rules.quality_rules(nothing).count() == 0


def test_js_distance():
    import numpy as np

    p = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0], [0.2, 0.3, 0.5]])
    q = np.array([0.5, 0.5, 0.0])
    d = quality_rules.js_distance(p, q)
    assert d[0] == 0 and abs(d[1] - 1) < 1e-12 and 0 < d[2] < 1


def test_quality_rejects_gibberish(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 300), "en") for i in range(30)] + [(99, " ".join("#" * rng.randint(1, 9) + str(i) for i in range(300)), "en")]
    got = rows_by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i]["kept"] for i in range(30)) and not got[99]["kept"]


def test_url_filter(spark, tmp_path):
    urls = [
        None, "", "no scheme", "http://a.org/x", "HTTP://EXAMPLE.org/es/1?q#f", "https://www.example.org/en/12", "https://example.org/en/2", "http://x.com/fr/1",
        "http://x.com/de/1", "http://x.com/it", "http://spam-farm.example.net/a", "http://m.spam-farm.example.net", "http://org", "http://notexample.org/es/",
        "x://u@h.com:80/fr/?://y", "http://é.org/ü", "http://a.org?x/",
    ]
    rows = [(i, u, "h", "v") for i, u in enumerate([*urls, *urls[:3]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = url_filter.filter_urls(pages, queries.URL_RULES, queries.BLOCK_HOSTS).collect()
    assert len(got) == len(rows)
    for r in got:
        u = rows[r["page_id"]][1]
        host = path = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = "".join(c.lower() if c < "\x80" else c for c in m[1]), m[2]
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1] if fits else None
        listed = any(host == b or host.endswith("." + b) for b in queries.BLOCK_HOSTS)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, max(fits)[2] if fits else "block" if listed else "allow")
    empty = url_filter.filter_urls(pages, [], []).collect()
    assert {r["verdict"] for r in empty} == {"allow"} and len(empty) == len(rows)


def test_url_digest_collisions(tmp_path):
    def bad(x):
        return len(x) % 3

    path = tmp_path / "i"
    path.write_bytes(url_filter.build_index([("allow", f"h{i}.com", "/") for i in range(40)], [f"b{i}.com" for i in range(40)], bad))
    a = url_filter.DigestArray(path, bad)
    for i in range(40):
        j = a.probe(url_filter.RULE, [f"h{i}.com/".encode()])[0]
        assert a.strings[a.offsets[j] : a.offsets[j + 1]].tobytes() == f"h{i}.com/".encode()
    assert a.probe(url_filter.RULE, [b"h1.net/"]) == [-1] and a.probe(url_filter.HOST, [b"h1.com/"]) == [-1]


def plain_substrings(texts, length):
    data = {i: (t or "").encode() for i, t, *_ in texts}
    first = {}
    for i in sorted(data):
        for s in range(len(data[i]) - length + 1):
            first.setdefault(data[i][s : s + length], i)
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        spans = len(re.findall(b"\x01+", bytes(gone)))
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def test_substring_dedup(docs, texts, nothing, spark):
    got = substring_dedup.remove_substrings(docs).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == plain_substrings(texts, 50)
    assert len(got) == len(texts)
    assert substring_dedup.remove_substrings(nothing).count() == 0
    twice = spark.createDataFrame([(1, "q" * 60), (1, "q" * 60), (None, "q" * 60), (2, "z" * 49)], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.remove_substrings(twice).collect()))
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 0), (True, 0, 60)]


def test_substring_dedup_many_batches(spark, monkeypatch):
    rng = random.Random(3)
    pieces = [prose(rng, 14) for _ in range(30)]
    texts = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 4))) + prose(rng, rng.randint(0, 6))) for i in range(300)]
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 4096)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_substrings(df).collect()}
    assert got == plain_substrings(texts, 50)


def plain_contamination(texts, items, window=13):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    wins = defaultdict(set)
    for name, t in items:
        w = words(t)
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[s : s + k])] |= set() if name is None else {str(name)}
    sizes = {len(w) for w in wins}
    out = {}
    for i, t, *_ in texts:
        w = words(t)
        hit, found = set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (g := tuple(w[s : s + k])) in wins:
                    hit |= set(range(s, s + k))
                    found |= wins[g]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_words", [200_000, 30])
def test_decontamination(spark, docs, texts, nothing, block_words):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    long = [t for _, t, *_ in texts if t and len(t) > 400]
    items = [(k, long[k][50:350]) for k in range(0, 12, 2)] + [(90, "the cat SAT"), (91, ""), (92, None), (93, "cat"), (94, long[3][:300]), (94, long[3][:300]), (95, prose(rng, 30)), (None, long[13][20:200]), (None, long[14])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(docs, bench, block_words=block_words)
    got = got.withColumn("sha", F.sha2(F.array_join(F.sort_array("items"), ","), 256)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["sha"], r["contaminated"]) for r in got} == plain_contamination(texts, items)
    assert decontamination.find_contamination(nothing, bench).count() == 0
    kept = decontamination.remove_contamination(docs, bench, block_words=block_words).collect()
    want = plain_contamination(texts, items)
    assert {r["doc_id"] for r in kept} == {i for i, x in want.items() if not x[4]}
    assert decontamination.remove_contamination(docs, bench.limit(0)).count() == len(texts)


def test_decontamination_cuts_spans():
    text = "One two, THREE four. Five"
    assert decontamination.cut(text, [(1, 3)]) == "One  four. Five"


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits=2):
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [8192, 5, 1])
def test_simhash(docs, texts, nothing, monkeypatch, bucket):
    monkeypatch.setattr(near_dup, "BUCKET", bucket)
    got = near_dup.near_duplicates(docs).collect()
    prints = {i: plain_fingerprint(t) for i, t, *_ in texts}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(prints)
    assert near_dup.near_duplicates(nothing).count() == 0


def test_simhash_links(spark):
    """Random fingerprints with planted neighbours: keys and forests lose no link."""
    import numpy as np

    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(150)]
    some = set(base)
    for b in base:
        for _ in range(rng.randint(0, 5)):
            x = b
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            some.add(x)
    fps = np.array(sorted(some), np.uint64)
    row, key = near_dup.keys_of(fps[:, None])
    met = defaultdict(list)
    for r, k in zip(row.tolist(), key.tolist(), strict=True):
        met[k].append(r)
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for group in met.values():
        for a, b in zip(*near_dup.spanning_links(fps[group][:, None], 2), strict=True):
            x, y = sorted((find(group[a]), find(group[b])))
            parent[y] = x
    assert {i: find(i) for i in range(len(fps))} == plain_components({i: int(f) for i, f in enumerate(fps)})


@pytest.mark.parametrize("bucket", [8192, 3])
def test_similar_texts(spark, monkeypatch, bucket):
    """128 bits: what differs in 8 bits or fewer always meets, every link found is one, and edited texts are found."""
    monkeypatch.setattr(near_dup, "BUCKET", bucket)
    rng = random.Random(6)
    base = [[word(rng) for _ in range(rng.randint(60, 200))] for _ in range(25)]
    rows, edits = [], {}
    for i, words in enumerate(base):
        rows.append((i, " ".join(words)))
        for j in range(3):
            new = list(words)
            for at in rng.sample(range(len(new)), len(new) * j // 100):
                new[at] = word(rng) + "x"
            edits[100 * (j + 1) + i] = i
            rows.append((100 * (j + 1) + i, " ".join(new)))
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (None, None), (None, "")], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in near_dup.near_duplicates(docs, scheme=near_dup.SIMILAR).collect()}
    of = {i: c for (i, _), c in got.items()}
    prints = {i: int.from_bytes(near_dup.fingerprint(t, near_dup.SIMILAR), "big") for i, t in rows}
    sure, all_links = plain_components(prints, 8), plain_components(prints, 26)
    for i in prints:
        assert of[i] == of[sure[i]] and all_links[of[i]] == all_links[i]
    assert sum(of[i] == of[j] for i, j in edits.items()) >= 0.95 * len(edits)
    assert len({of[i] for i in range(25)}) == 25
    kept = near_dup.drop_near_duplicates(docs).collect()
    assert len(kept) == len({of[i] for i, _ in rows}) + 1  # texts without words are one group


def test_golay():
    import numpy as np

    from provspark.llm import golay

    words = golay.decode(np.arange(1 << 12) << 11)
    assert sorted(np.bincount(golay.decode(np.arange(1 << 23)))) == [2048] * 4096
    assert len(words) == 4096
    row, _ = golay.neighbour_keys(np.arange(1 << 16))
    assert set(np.bincount(row).tolist()) == {1, 6}


def plain_lines(texts, run, long_words):
    seq = {i: [x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")] for i, t, *_ in texts}
    seq = {i: [x for x in s if x] for i, s in seq.items()}
    seen, gone = set(), defaultdict(set)
    places = []
    for i in sorted(seq):
        for s in range(len(seq[i])):
            if s + run <= len(seq[i]):
                places.append((i, s, run))
            if len(SPACE_WORD.findall(seq[i][s])) >= long_words:
                places.append((i, s, 1))
    for i, s, n in places:
        key = (n, tuple(seq[i][s : s + n]))
        if key in seen:
            gone[i] |= set(range(s, s + n))
        seen.add(key)
    return {i: (len(seq[i]), len(gone[i])) for i in seq}, gone


@pytest.mark.parametrize(("run", "long_words"), [(3, 50), (2, 8), (1, 1000)])
def test_line_dedup(spark, docs, texts, nothing, run, long_words):
    want, gone = plain_lines(texts, run, long_words)
    got = line_dedup.remove_repeated_lines(docs, run, long_words).collect()
    assert {r["doc_id"]: r["__n_removed"] for r in got} == {i: n for i, (_, n) in want.items()}
    assert len(got) == len(texts)
    text = {i: t for i, t, *_ in texts}
    for r in got:
        if text[r["doc_id"]] is None:
            assert r["text"] is None
            continue
        lines = [x for x in text[r["doc_id"]].split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        left = [x for k, x in enumerate(lines) if k not in gone[r["doc_id"]]]
        assert [x for x in r["text"].split("\n") if x.strip(" \t\n\x0b\x0c\r")] == left
    assert line_dedup.remove_repeated_lines(nothing).count() == 0
    kept = line_dedup.drop_repeated_lines(docs, run, long_words)
    assert kept.columns == docs.columns
    whole = {i for i, (n, k) in want.items() if n and n == k}
    assert {r["doc_id"] for r in kept.collect()} == set(text) - whole


def test_language_id(spark, nothing):
    import zlib

    rng = random.Random(4)
    sets = {"aa": "ba be bi bo bu".split(), "bb": "ka ke ki ko ku".split(), "cc": "ça çe çi ño ñu".split()}
    rows = []
    for i in range(600):
        lang = rng.choice(list(sets))
        text = " ".join("".join(rng.choice(sets[lang]) for _ in range(3)) for _ in range(rng.randint(1, 30)))
        rows.append((i, text, lang, "x"))
    rows += [(1000, None, "aa", "x"), (1001, "123 --- ", "bb", "x"), (1002, "", None, "x"), (1003, "zzz qqq", None, "x"), (1003, "zzz qqq", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id.identify_languages(df).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:600]}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1000, 1001, 1002):
            assert r["lang_pred"] == "und"
        else:
            assert r["lang_pred"] in sets
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert language_id.identify_languages(nothing).count() == 0


def test_many_languages(spark):
    """More languages than a mask word has bits, each with letters of its own."""
    rng = random.Random(5)
    rows = []
    for i in range(70 * 8):
        letters = [chr(0x4E00 + 3 * (i % 70) + k) for k in range(3)]
        rows.append((i, " ".join("".join(rng.choices(letters, k=4)) for _ in range(20)), f"l{i % 70:02}"))
    got = rows_by_id(language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)


def plain_kept(rows):
    """{id: kept} of (id, text, lang), from the rule's own words."""

    def shares(text):
        classes = Counter()
        for c in text:
            low = c.isascii()
            classes[
                "space" if c in " \t\n\x0b\x0c\r" else "symbol" if c in "#*$%&|<>" else "point" if c in ".,;:!?'\"()-" else "digit" if low and c.isdigit()
                else ("other" if low else "wide") if not c.isalpha() or ord(c) >= 0x1FFF else "upper" if c.isupper() else "lower" if low else "wide lower"
            ] += 1
        words = Counter(w if w in quality_rules.WORDS else None for w in (re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in SPACE_WORD.findall(text)))
        return classes, words

    def failed(text):
        words = SPACE_WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {k for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for k in range(j, j + 3)}
        return len(words) < 50 or 2 * len(hit) > len(words)

    def distance(p, q):
        p, q = ({k: n / sum(x.values()) for k, n in x.items()} for x in (p, q))
        mid = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in p.keys() | q.keys()}
        return (sum(n * math.log2(n / mid[k]) for x in (p, q) for k, n in x.items()) / 2) ** 0.5

    refs = defaultdict(lambda: (Counter(), Counter()))
    for _, t, lang in rows:
        if not failed(t):
            for total, own in zip(refs[lang], shares(t), strict=True):
                total.update(own)
    out = {}
    for i, t, _ in rows:
        c, w = shares(t)
        near = any(
            (c.total() < 200 or distance(c, rc) <= quality_rules.LIMIT_CLASS) and (w.total() < 200 or distance(w, rw) <= quality_rules.LIMIT_WORD) for rc, rw in refs.values()
        )
        out[i] = not failed(t) and near
    return out


def test_quality_kept(spark):
    """Verdicts against plain distances, with more languages than 256."""
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.choice([30, 60, 90])), f"l{i}") for i in range(300)]
    common = "the of and to a in is that le la de et".split()
    for i in range(300, 360):
        share = rng.random()
        text = " ".join(rng.choice(common) if rng.random() < share else word(rng) + rng.choice(["", "#", "7", "É", "中"]) for _ in range(rng.randint(40, 400)))
        rows.append((i, text, rng.choice(["a", None])))
    rows += [(400 + i, " ".join("#$%"[i % 3] * rng.randint(1, 9) + str(k) for k in range(300)), "z") for i in range(2)]
    got = rows_by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    want = plain_kept(rows)
    assert {i: r["kept"] for i, r in got.items()} == want
    assert 0 < sum(want.values()) < len(want)


def test_weak_labels_recover_accuracies():
    rng = random.Random(6)
    right = [0.95, 0.9, 0.8, 0.7]
    counts, truth = Counter(), defaultdict(Counter)
    for _ in range(20000):
        y = rng.random() < 0.2
        votes = [classifier.ABSTAIN if rng.random() < 0.2 else (classifier.REJECT if (rng.random() < a) == y else classifier.ACCEPT) for a in right]
        counts[classifier.code_of(votes)] += 1
        truth[classifier.code_of(votes)][y] += 1
    post, given = classifier.estimate(counts, 4)
    hit = sum(truth[c][post[c] > 0.5] for c in counts)
    assert hit > 0.93 * 20000
    for j, a in enumerate(right):
        assert abs(given[0, j, classifier.ACCEPT] / given[0, j, 1:].sum() - a) < 0.05


def test_classifier(spark, nothing):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(500):
        text = prose(rng, 120)
        bad, toxic = i % 9 == 4, i % 7 == 3
        if bad:
            text = " ".join(w + "***" for w in text.split())
        if toxic:
            for w in ("idiot", "grunkelo", "grunkela"):
                text = text.replace(" ", f" {w} ", 2)
        rows.append((i, text, "x"))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "  ", "x"), (903, "one", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = rows_by_id(classifier.classify(df, lab))
    assert len(got) == len(rows)
    wrong = [i for i in range(500) if got[i]["accepted"] == (i % 9 == 4 or i % 7 == 3)]
    assert len(wrong) <= 25
    kept = classifier.keep_accepted(df, lab)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["accepted"]}
    assert classifier.classify(nothing, lab).count() == 0
    assert classifier.classify(df, lab.limit(0)).count() == len(rows)
