"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerweave.llm import ann, chat, html_main, language_id, line_dedup, mixing, neardup, packing, quality, token_counts
from ledgerweave.llm.queries import OP5_SQL, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that the operators use inside.
CLASH = ", _id string, _h string, rep string, row string, block string, h string, size string, family string, key string, good string"
RNG = random.Random(4)
SYLLABLES = "ka lo mi ter un der ein the ing ous que ment ción ado ß ü".split()


def words(n, rng=RNG):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = words(120)
    edited = base.split()
    edited[60] = "changed"
    shared = "\n".join([words(30), words(30)])
    out = [
        (1, base, "en", "a", 1), (2, " ".join(edited), "en", "a", 1), (3, base.upper(), "en", "b", 1), (4, base, "de", None, 1),
        (5, None, "en", "b", None), (6, "", None, "b", 0), (7, " \n\t ", "en", "c", 4), (8, "!!! 123", "en", "c", 7), (9, "one two", "en", "c", 7),
        (10, "One TWO", "en", None, 7), (11, words(20) + "\n" + shared, "fr", "d", 1), (12, words(25) + "\n" + shared + "\n" + words(9), "fr", "d", 1),
        (13, words(9000), "es", "e", 1), (14, "x" * 50_000, "es", "e", 1), (15, "<|endoftext|> a<|startoftext|>b    Ǆ ΑΣ 漢字 é é", "es", "e", 1),
        (15, "<|endoftext|> a<|startoftext|>b    Ǆ ΑΣ 漢字 é é", "es", "e", 1), (16, words(50), "en", "a", 1), (16, words(50), "en", "a", 1),
        (None, base, "en", "a", 1), (None, None, None, None, None),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = CLASH.count("string")
    return spark.createDataFrame([(*r, *["z"] * extra) for r in rows], DOCS + CLASH).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def same(df, expected):
    assert Counter(map(tuple, df.collect())) == Counter(expected)


def test_token_counts(docs, none, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    same(token_counts.count_tokens(docs, path), [(r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows])
    assert token_counts.count_tokens(none, path).isEmpty()


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    expected = Counter()
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            expected[r[0], p, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), np.array(own, "<u4").tobytes()] += 1
    got = packing.pack(docs, path, with_ids=True, part=6).collect()
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32, bytes(g.ids)) for g in got) == expected
    full = defaultdict(list)
    for g in got:
        full[g.sequence_id].append((g.offset, g.length))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(full) == -(-sum(g.length for g in got) // 2048)
    assert packing.pack(none, path).isEmpty()


def test_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(1)
    for trial in range(60):
        size = int(rng.integers(8, 60))
        x = rng.integers(1, size + 1, int(rng.integers(1, 40)))
        bins = packing.best_fit_decreasing(x, size)
        fill = np.bincount(bins, weights=x)
        assert fill.max() <= size
        bound = packing.lower_bound(np.bincount(x, minlength=size + 1))
        assert -(-x.sum() // size) <= bound <= len(fill), trial
    assert packing.lower_bound(np.bincount([6] * 5, minlength=11)) == 5  # five items over half a bin


def test_near_duplicates(docs, none, rows):
    for percent in (80, 85):
        sets = []
        for r in rows:
            w = [x.lower() for x in (r[1] or "").encode().split()]
            sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        label = {i: i for i in range(len(rows))}

        def find(i, label=label):
            return i if label[i] == i else find(label[i])

        for i in range(len(rows)):
            for j in range(i):
                if rows[i][0] is None or rows[j][0] is None:
                    continue
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]) or rows[i][0] == rows[j][0]:
                    label[find(i)] = find(j)
        least = {}
        for i, r in enumerate(rows):
            if r[0] is not None:
                least[find(i)] = min(least.get(find(i), r[0]), r[0])
        expected = [(r[0], len(sets[i]), least[find(i)] if r[0] is not None else None, r[0] is None or r[0] == least[find(i)]) for i, r in enumerate(rows)]
        same(neardup.classes(docs, percent), expected)
    assert neardup.classes(none).isEmpty()


def test_near_duplicates_in_large_families(spark, monkeypatch):
    """Blocks, hubs and the last cross comparison: families over the block size, checked against all pairs."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "HUBS", 2)
    rng = random.Random(9)
    texts = []
    for _ in range(3):
        base = words(90, rng).split()
        for _ in range(40):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = words(1, rng)
            texts.append(t)
        for _ in range(25):  # a drifting chain
            base = list(base)
            base[rng.randrange(len(base))] = words(1, rng)
            texts.append(base)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, " ".join(t), None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in neardup.classes(df, 85).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_language(docs, none, spark):
    rng = random.Random(2)
    train = [(i, " ".join(rng.choices(s.split(), k=30)), lang, "s", 1) for i in range(60) for lang, s in (("en", "the of and ing"), ("de", "der die und ung"), ("fr", "les que ment aux"), ("es", "los del ción"))]
    codes = language_id.fit(spark.createDataFrame([*train, (1, "zzz", None, None, 1)], DOCS))
    assert codes.langs == ["de", "en", "es", "fr"]
    assert all((a != b).sum() >= 4 for i, a in enumerate(codes.words) for b in codes.words[:i])
    got = {(r.doc_id, r.text): r for r in language_id.predict(docs.select("doc_id", "text"), codes).collect()}
    for r in got.values():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    fresh = spark.createDataFrame([(9, "the ing of the", None, None, 1), (10, "der und die", None, None, 1)], DOCS)
    assert [r.lang_pred for r in language_id.predict(fresh, codes).orderBy("doc_id").collect()] == ["en", "de"]
    assert language_id.predict(none, codes).isEmpty()
    assert {r.lang_pred for r in language_id.predict(docs.select("text"), language_id.fit(none)).collect()} == {"und"}
    one = language_id.fit(spark.createDataFrame([(1, "aha", "en", None, 1)], DOCS))
    assert {r.lang_pred for r in language_id.predict(fresh, one).collect()} == {"en"}


def test_quality(docs, none, spark, rows):
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0, 0) for i in range(1, 17)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, quality.fit(docs, labels)).collect()
    expected = []
    for r in rows:
        text = r[1] or ""
        w = text.encode().split()
        spans = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if spans[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        n = len(w)
        expected.append((r[0], n, sum(len(x.decode()) for x in w), sum(x.decode().count(c) for x in w for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n))
    assert Counter(tuple(g)[:7] for g in got) == Counter(expected)
    assert not any(g.kept and g.base_failed for g in got)
    assert quality.judge(none, quality.fit(none, labels)).isEmpty()
    assert quality.threshold(np.array([0.0, 1.0, 2.0, 3.0]), np.array([False, False, True, True])) == 1.5


def test_quality_tells_bad_words(spark):
    rng = random.Random(3)
    good = "river stone cloud meadow autumn harbour window garden letter travel".split()
    bad = [*good[:7], "slime", "grime", "scum"]
    data = [(i, " ".join(rng.choices(bad if i % 3 == 0 else good, k=60)), None, None, 1) for i in range(900)]
    df = spark.createDataFrame(data, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = quality.judge(df, quality.fit(df, labels)).filter("doc_id >= 600 AND NOT base_failed").collect()
    assert all(g.kept == (g.doc_id % 3 != 0) for g in got) and len(got) > 200


def test_quality_tells_few_toxic_words(spark):
    """Four of ten toxic words among 200 others are not diluted, though clean texts of a subject rare among the labels have lower means."""
    rng = random.Random(14)
    common, rare, toxic = [f"w{i}" for i in range(200)], [f"v{i}" for i in range(200)], [f"slur{i}" for i in range(10)]
    data = []
    for i in range(2400):
        subject = rare if i % 20 == 1 or i >= 1600 and i % 5 == 2 else common
        data.append((i, " ".join(rng.choices(subject, k=200) + (rng.choices(toxic, k=4) if i % 8 == 0 else [])), None, None, 1))
    df = spark.createDataFrame(data, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(1600)], "doc_id long, quality int, toxic int")
    got = quality.judge(df, quality.fit(df, labels)).filter("doc_id >= 1600 AND NOT base_failed").collect()
    bad = [g.kept for g in got if g.doc_id % 8 == 0]
    assert len(bad) == 100 and sum(bad) <= 20
    assert sum(not g.kept for g in got if g.doc_id % 8) <= 35


def test_patience_alignment():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.randint(0, 9) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 9) for _ in range(rng.randint(0, 14))]
        pairs = line_dedup.matched(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        # No line of b stays that alone would be a block.
        left = [j for j in range(len(b)) if j not in set(line_dedup.common_lines(a, b, [line_dedup.BLOCK_WORDS] * len(b)))]
        assert not {b[j] for j in left} & set(a)
    assert line_dedup.matched([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert line_dedup.common_lines([1, 2, 3], [7, 1, 2], [9, 3, 4]) == []  # a block of seven words


def test_line_dedup(docs, none, rows, spark):
    got = line_dedup.dedup(docs, ["doc_id", "source"]).collect()
    texts = defaultdict(list)
    for g in got:
        texts[g.doc_id].append(g.text)
    assert len(got) == len(rows)
    assert texts[1] == [rows[0][1]] and texts[4] == [""] and texts[5] == [None] and texts[6] == [""]
    assert texts[12] == ["\n".join(np.array(rows[11][1].split("\n"))[[0, 3]])] and texts[11] == [rows[10][1]]
    assert Counter(texts[None]) == Counter([rows[0][1], None]) and len(texts[15]) == 2 and texts[15][0] == texts[15][1]
    assert line_dedup.dedup(none, ["doc_id"]).isEmpty()
    line = words(12)
    many = spark.createDataFrame([(i, line if i % 3 else f"{line}\nown {i}", None, None, 1) for i in range(200)], DOCS)
    assert {r.doc_id: r.text for r in line_dedup.dedup(many, ["doc_id"]).collect()} == {i: (line + "\nown 0" if i == 0 else "" if i % 3 else f"own {i}") for i in range(200)}


def test_line_dedup_finds_each_block(spark):
    """Blocks of short lines that no document with a common longer line owns, against all pairs of documents."""
    rng = random.Random(10)
    pool = [words(n, rng) for n in (1, 1, 2, 3, 4, 5, 6, 7, 9)] + [""]
    texts = [[rng.choice(pool) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    poem, line = [words(2, rng) for _ in range(9)], [words(6, rng), words(6, rng)]
    texts += [[line[0], "x y"], [line[1], "y z"], ["own one", *line], [*poem, "own two"], [*line, "own three"], ["own four", *poem]]
    u = [words(3, rng) for _ in range(5)]  # more scattered matches than the block has lines
    texts += [[*u, *poem[2:6]], [*poem[2:6], u[0], "p", u[1], "q", u[2], "r", u[3], "s", u[4]]]
    expected = {}
    for i, text in enumerate(texts):
        gone = set()
        for a in range(len(text)):
            for b in range(a + 1, len(text) + 1):
                if len(" ".join(text[a:b]).split()) >= line_dedup.BLOCK_WORDS and any(t[k : k + b - a] == text[a:b] for t in texts[:i] for k in range(len(t))):
                    gone |= set(range(a, b))
        expected[i] = [x for k, x in enumerate(text) if x and k not in gone]
    df = spark.createDataFrame([(i, "\n".join(t), None, None, 1) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: [x for x in (r.text or "").split("\n") if x] for r in line_dedup.dedup(df, ["doc_id"]).collect()}
    assert got == expected
    assert got[64] == ["own three"] and got[65] == ["own four"]
    assert line_dedup.common_lines([*range(1, 6), 8, 9], [8, 9, 1, 6, 2, 7, 3, 0, 4, 10, 5], [4, 4] + [1] * 9) == [0, 1]


def test_mixing(docs, none, spark, rows):
    size = [len((r[1] or "").encode().split()) for r in rows]
    total = Counter()
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    full = set()
    while True:
        level = (1.5 * sum(size) - sum(2 * total[s] for s in full)) / sum(weight[s] for s in total if s not in full)
        more = {s for s in total if s not in full and weight[s] * level > 2 * total[s]}
        if not more:
            break
        full |= more
    target = {s: 2 * total[s] if s in full else weight[s] * level for s in total}
    got = mixing.taken_words(docs).collect()
    assert Counter((g.doc_id, g["size"], g.source_size, round(g.target, 6)) for g in got) == Counter((r[0], n, total[r[3]], round(target[r[3]], 6)) for r, n in zip(rows, size, strict=True))
    assert all(g.taken <= 2 * g["size"] for g in got)
    by = Counter()
    for g in got:
        by[round(g.target, 6), g.source_size] += g.taken
    assert all(abs(n - t) <= mixing.BLOCK_WORDS for (t, _), n in by.items())
    assert Counter(map(tuple, mixing.taken_words(docs.repartition(7)).collect())) == Counter(map(tuple, got))
    assert mixing.taken_words(none).isEmpty() and mixing.stage_rows(none).isEmpty()


def test_mixing_shards(spark):
    """Shards have exact sizes and disjoint blocks, and every source reaches every shard in about its share."""
    rng = random.Random(6)
    df = spark.createDataFrame([(i, words(rng.randint(1, 400), rng), None, rng.choice("aaab"), 1) for i in range(300)], DOCS)
    wanted, mixed = mixing.mix(mixing.pinned(df), block_words=16, shard_words=4096)
    got = mixed.collect()
    assert len({(g["row"], g["pass"], g.block) for g in got}) == len(got)
    sizes = Counter(g.shard for g in got)
    assert len(sizes) > 10 and max(sizes.values()) - min(sizes.values()) <= 2
    for shard, n in sizes.items():
        assert sorted(g.spot for g in got if g.shard == shard) == list(range(1, n + 1))
    assert abs(sum(g.n_words for g in got) - sum(w.target for w in wanted.collect())) <= 2 * 16


def test_split_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(50):
        q = rng.integers(0, 50, 6).tolist()
        left, right = mixing.split(q, 0.4, rng)
        assert [a + b for a, b in zip(left, right, strict=True)] == q and sum(left) == round(sum(q) * 0.4)
        assert min(left) >= 0 and min(right) >= 0
    assert 0 <= mixing._draw(3_000_000_000, 1_000_000_000, 100, rng) <= 100


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 12))
    x[100:400] = x[100] + 0.001 * rng.standard_normal((300, 12))  # one crowded bucket
    x[450] = x[451]
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    rows += [(900, None, "z"), (950, [], "z"), (1000, [0.0] * 12, "z"), (1050, [1.0, None] + [0.0] * 10, "z"), (1100, [float("nan")] * 12, "z"), (None, [1.0] * 12, "z"), (1150, [float("inf")] * 12, "z")]
    rows += [(0, x[0].tolist(), "z"), (451, x[451].tolist(), "z"), (1200, [1.0, 2.0], "z"), (1201, [2.0, 1.0], "z")]
    df = ann.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket string"))
    got = defaultdict(list)
    for r in ann.nearest(df.filter("id % 50 = 0"), df, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 600, 50):
        score = unit[q] @ unit.T
        true = sorted((i for i in range(600) if i != q), key=lambda i: (-score[i], i))[:5]
        assert [g[0] for g in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[i]) < 1e-12 for _, i, s in got[q])
        hit += len({i for _, i, _ in got[q]} & set(true))
    assert hit / 60 >= 0.9
    assert [(r, i) for r, i, _ in got[1200]] == [(1, 1201)] and set(got) == {*range(0, 600, 50), 1200}
    assert [i for _, i, _ in got[450]][:1] == [451]
    empty = df.filter("id < 0")
    assert ann.nearest(empty, empty).isEmpty()


def test_neighbours_of_repeated_ids(spark):
    """Ids in more rows than k, equal and differing ones, push no other neighbour out."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((40, 6))
    ids = np.concatenate([np.arange(40), np.repeat(np.arange(40), 9)])
    y = np.concatenate([x, np.repeat(x, 9, axis=0)])
    y[200:] += 0.01 * rng.standard_normal((len(y) - 200, 6))
    score = ann._unit(x) @ ann._unit(y).T
    best = [{int(i): float(score[q][ids == i].max()) for i in range(40) if i != q} for q in range(40)]
    true = [sorted(b, key=lambda i: (-b[i], i))[:5] for b in best]
    got = ann.best(x, np.arange(40), y, ids, 5)
    assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == [(q, i) for q in range(40) for i in true[q]]
    assert all(abs(s - best[q][i]) < 1e-12 for q, i, s in zip(*(g.tolist() for g in got), strict=True))
    rows = ann.vectors(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, y, strict=True)], "vec_id long, embedding array<double>"))
    queries = ann.vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    once = ann.vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert ann.sampled_cosines(queries.unionByName(once), 5) == ann.sampled_cosines(once, 5)
    # Every bucket is compared: 39 others are fewer than k.
    found = {}
    for r in ann.nearest(queries, rows, 40).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {q: sorted(best[q], key=lambda i: (-best[q][i], i)) for q in range(40)}


def test_probes_come_in_order_of_chance():
    chance = {}
    for a, ca in ann.cell_chances(0.4, 0.2, 0.8):
        for b, cb in ann.cell_chances(-0.9, 0.7, 0.8):
            chance[ca, cb] = a * b
    order = [tuple(p) for p in ann.probes([0.4, -0.9], [0.2, 0.7], 0.8, 0.99)]
    got = [chance[p] for p in order]
    assert got == sorted(got, reverse=True) and len(set(order)) == len(order) and sum(got) >= 0.99


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a </turn>\n### User: b\\t\\b\\h"), (2, 1, "assistant", "late"), (2, 0, "system", ""), (3, None, None, None),
    (3, 0, "user: x", "# ## ### #### </turn"), (4, 0, "user", "twice"), (4, 0, "user", "twice"), (None, 0, "user", "\\"), (5, 0, "user", "y" * 100_000), (5, 1, "assistant", "漢\U0001f600"),
]


def test_chats(spark):
    df = spark.createDataFrame([(*c, "z") for c in CHATS], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.format_chats(df).select("*", chat.read_back("formatted").alias("back"), chat.loss_text("segments").alias("loss")).collect()}
    for conv in (1, 2, 3, 4, 5, None):
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in CHATS if c == conv))
        assert [tuple(b) for b in got[conv].back] == [m[2:] for m in mine]
        assert got[conv].loss == "".join(m[3] for m in mine if m[2] == "assistant")
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted
    assert [got[c].bad_turn for c in (1, 2, 3, 4, 5)] == [-1, 1, 0, 1, -1]
    assert chat.format_chats(df.filter("conv_id > 99")).isEmpty()


def test_chat_sql_agrees(spark, tmp_path):
    import duckdb
    from ledgerweave.llm.queries import QUERIES

    spark.createDataFrame([c for c in CHATS if c[0] is not None], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    # The SQL is for roles without control strings.
    con.execute("CREATE OR REPLACE TABLE plain AS SELECT * FROM conversations WHERE conv_id <> 3")
    sql = OP5_SQL.replace("FROM conversations", "FROM plain")
    got = QUERIES["op5_chat_formatting"](spark, str(tmp_path)).filter("conv_id <> 3").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(sql).fetchall()) and len(got) == 5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="ad">Buy it now.</div><article><h1>%s</h1><p><b>%s.<br><p>%s  &amp;\n more.</p></article><footer>&copy; site</footer>%s"""


def test_html(spark):
    rng = random.Random(8)
    data = [(i, f"u{i}", PAGE % (words(5, rng), words(30, rng), words(25, rng), "</body></html>" if i % 2 else "")) for i in range(60)]
    odd = [(100, None, None), (101, "u", ""), (102, "u", "<"), (103, "u", "<div><p>" * 3000), (0, "u0", data[0][2]), (104, "u", "<nav><a href=x>only</a></nav>")]
    df = spark.createDataFrame([(*d, "z") for d in data + odd], "page_id long, url string, html string, text string")
    trees = html_main.fit(df)
    got = {r.page_id: r for r in html_main.extract(df, trees).collect()}
    for i, _, html in data:
        h, a, b = html.split("<h1>")[1].split("</h1>")[0], html.split("<b>")[1].split("<br>")[0], html.split("<br><p>")[1].split("</p>")[0]
        assert got[i].text == f"{h}\n{a}\n{b.replace('&amp;', '&').replace(chr(10), ' ').replace('   ', ' ').replace('  ', ' ')}"
        assert got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in (100, 101)] == ["", ""]
    assert html_main.extract(df.filter("page_id < 0"), html_main.fit(df.filter("page_id < 0"))).isEmpty()


def test_decoding_never_keeps_inside_dropped():
    rng = np.random.default_rng(3)
    nodes = html_main.elements(html_main.parsed("<div><p>a<b>c</b></p><ul><li>x<li>y</ul></div>" * 5))
    at = {id(n): i for i, n in enumerate(nodes)}
    for _ in range(50):
        kept = html_main.decode(nodes, rng.random(len(nodes)))
        assert all(kept[at[id(n.parent)]] for n, k in zip(nodes[1:], kept[1:], strict=True) if k)
