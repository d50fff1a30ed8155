"""Merkle manifest, spelling variants and token counts against brute force and the library."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelcorr.llm import common, merkle, mixing, pieces, spelling, token_counts


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, cut=False):
    text = row[4].replace("\n", "") if cut and row[4] is not None else row[4]
    return h(*map(field, (*row[:4], text)))


def tree(leaves):
    """The levels of a tree, lowest first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def folded(levels, at, node):
    seen = []
    for level in levels[:-1]:
        start = at - at % 3
        run = level[start : start + 3]
        seen += run[: at - start] + run[at - start + 1 :]
        node = h(*run[: at - start], node, *run[at - start + 1 :])
        at //= 3
    return node, seen


def brute_manifest(rows):
    """Per row, in the order given: leaf, subroot, root, proof, folded root."""
    sources = sorted({r[1] for r in rows}, key=lambda s: b"" if s is None else b"+" + s.encode())
    trees, places = [], {}
    for source in sources:
        own = [i for i, r in enumerate(rows) if r[1] == source]
        own.sort(key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf(rows[i])))
        places |= {i: (len(trees), at) for at, i in enumerate(own)}
        trees.append(tree([leaf(rows[i]) for i in own]))
    top = tree([t[-1][0] for t in trees])
    found = []
    for i, row in enumerate(rows):
        k, at = places[i]
        even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        node, low = folded(trees[k], at, leaf(row, cut=even))
        node, high = folded(top, k, node)
        found.append((leaf(row), trees[k][-1][0], top[-1][0], h(*low, *high), node))
    return found


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, tree int, idx int"


def manifest_rows(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    made = merkle.manifest(merkle.document_leaves(docs))
    return merkle.checked(merkle.proofs(made), "tampered", made.root).collect()


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest_equals_brute_force(spark, monkeypatch, height):
    """Small builders too, so that trees take several rounds."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rng = random.Random(height)
    sizes = {"hot": 90, "one": 1, None: 7, "": 3, "é": 28, "z": 4, "a b": 9, "Z": 2}
    rows = [
        (i, s, rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", f"a\nb{i}", "ü\n\n"]))
        for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))
    ]
    rng.shuffle(rows)
    found = {(r["id"]): r for r in manifest_rows(spark, rows)}
    for row, wanted in zip(rows, brute_manifest(rows)):
        got = found[row[0]]
        names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
        assert tuple(got[c] for c in names) == wanted
        assert got["verified"] == (wanted[4] == wanted[2])
    assert not all(r["verified"] for r in found.values())


def test_manifest_of_odd_rows(spark):
    """Null ids and texts, repeated rows, and ids that are not unique."""
    rows = [(None, None, None, None, None), (None, "a", "en", 1, "x\n"), (1, "a", "en", 1, "x"),
            (1, "a", "en", 1, "x"), (1, "a", "en", 1, "y\n"), (2, "b", None, None, "\n" * 50_000)]
    got = manifest_rows(spark, rows)
    wanted = brute_manifest(rows)
    pick = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    assert sorted(tuple(r[c] for c in pick) for r in got) == sorted(wanted)
    one = manifest_rows(spark, rows[1:2])
    assert one[0]["root"] == one[0]["leaf"] == one[0]["subroot"] and one[0]["proof_sha256"] == h()
    assert manifest_rows(spark, []) == []


def test_places_in_the_log():
    """The closed form agrees with nodes logged one by one, at every size."""
    for n in range(1, 100):
        height = merkle.levels(n)
        leaves = [bytes([i]) * 32 for i in range(n)]
        log, top = merkle.postorder(leaves, height)
        levels = tree([x.hex() for x in leaves])
        assert top.hex() == levels[-1][0] and len(log) == sum(map(len, levels))
        for i in range(n):
            assert log[merkle.position(i)] == leaves[i]
            at = i
            for (left, right), level in zip(merkle.siblings(i, n, height), levels):
                start = at - at % 3
                run = level[start : start + 3]
                assert [log[p].hex() for p in (*left, *right)] == run[: at - start] + run[at - start + 1 :]
                at //= 3


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def words_like(seed, n):
    """Words around a few stems, one to three edits away, with repeated letters and accents."""
    rng = random.Random(seed)
    letters = "abéñÿa"
    found = set()
    while len(found) < n:
        word = list("".join(rng.choices(letters, k=rng.choice([6, 7, 8, 12]))))
        if found and rng.random() < 0.8:
            word = list(rng.choice(sorted(found)))
            for _ in range(rng.choice([1, 1, 2, 3])):
                at = rng.randrange(len(word) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    word.insert(at, rng.choice(letters))
                elif at < len(word) and kind == 1 and len(word) > 6:
                    del word[at]
                elif at < len(word):
                    word[at] = rng.choice(letters)
        if len(word) >= 6:
            found.add("".join(word))
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_words_equal_all_pairs(spark, seed):
    words = words_like(seed, 300) + ["a" * k for k in (6, 7, 8, 300, 301)]
    df = spark.createDataFrame([(w,) for w in (*words, words[0], None)], "word string")
    got = {tuple(r) for r in spelling.near_words(df).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def brute_words(rows):
    import re

    seen = Counter()
    for number, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            x = zlib.crc32(f"{number}:{run}".encode())
            if x % 199 == 0:
                run = run[: x % len(run)] + run[x % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6}


def test_words_are_counted_with_their_noise(spark):
    rng = random.Random(4)
    pool = ["Wörterbuch", "WORDS", "ordinary", "sixsix", "ÉCOLES", "x×÷yabc", "short", "naïveté"]
    rows = [(i, " ,".join(rng.choices(pool, k=40))) for i in range(300)] + [(999, None), (1000, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    assert {r["word"]: r["n"] for r in spelling.word_counts(df).collect()} == brute_words(rows)
    assert spelling.word_counts(df.limit(0)).count() == 0


def test_forms_and_roots(spark):
    counts = {"kitten": 1000, "kittens": 100, "kittenz": 100, "kittensy": 11, "mittens": 19,
              "kitteno": 500, "lonely": 7, "lonelyx": 1}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = {r["word"]: r for r in spelling.spelling_variants(df).collect()}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    for word, row in rows.items():
        best = min(near[word], key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 5 * counts[word] else None
        assert (row["n"], row["n_near"], row["form"]) == (counts[word], len(near[word]), form)
        assert row["form_n"] == (counts[form] if form else None)
        root = word
        while rows[root]["form"]:
            root = rows[root]["form"]
        assert row["root"] == root
    assert rows["kittensy"]["root"] == "kitten"
    assert spelling.spelling_variants(df.limit(0)).count() == 0


@pytest.mark.parametrize("small", [0, 2_000, 1_000_000])
def test_only_measured_states_are_broadcast(spark, plan, monkeypatch, small):
    """These tables are far below the size up to which Spark broadcasts on its own."""
    plans = []

    def written(df, name):
        plans.append((name, plan(df)))
        return common.written(df, name)

    monkeypatch.setattr(spelling, "written", written)
    monkeypatch.setattr(spelling, "SMALL", small, raising=False)
    words = words_like(3, 200)
    df = spark.createDataFrame([(w, 5 * 7 ** (i % 4)) for i, w in enumerate(words)], "word string, n long")
    told = spelling.spelling_variants(df)
    plans.append(("told", plan(told)))
    assert sum(r["n_near"] for r in told.collect()) == sum(one_edit(a, b) for a in words for b in words)
    sent = [name for name, text in plans if "Broadcast" in text.partition("== Physical Plan ==")[2]]
    # The first states come from all places of all words; neither these nor words are sent.
    steps = [name for name, _ in plans].count("states") - 1
    assert steps > 2 and sent == ["states"] * len(sent)
    assert len(sent) == {0: 0, 1_000_000: steps}.get(small, len(sent)) and (small != 2_000 or len(sent) < steps)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_counts.MODEL))


def test_counts_equal_the_library(spark, library):
    rng = random.Random(5)
    kinds = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0x250), lambda: rng.randrange(0xD800),
             lambda: rng.randrange(0xE000, 0x110000), lambda: rng.choice([9, 10, 32, 39, 0xA0, 0x1F600])]
    texts = ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(80))) for _ in range(600)]
    texts += ["", "I'll they've DON'T 's", "  two  blanks \n\n end  ", "a" * 4000, "na" * 3000,
              "x<|endoftext|>y<|endoftext|><|endoftext|>", "<|endoftext", "𒑯 𒔐ab1𖿴", "word " * 50_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = {r["id"]: r for r in token_counts.token_counts(df).collect()}
    wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [rows[i]["n_tokens"] for i in range(len(texts))] == wanted
    assert [rows[i]["n_bytes"] for i in range(len(texts))] == [len(t.encode()) for t in texts]
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows.values())


def test_counts_of_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "two words"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"] or 0, r["n_tokens"], r["n_whole"]) for r in token_counts.token_counts(df).collect())
    assert got == [(0, 2, 2), (1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert token_counts.token_counts(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_whole_tokens_are_those_of_the_library(library):
    vocabulary = token_counts.read_vocabulary(public_tokenizers.path(token_counts.MODEL))
    whole = token_counts.whole_tokens(vocabulary)
    some = random.Random(6).sample(sorted(whole), 2000)
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in some)
    merger = token_counts.Merger(vocabulary)
    for text in ("hello", " Größe", "aaaaaaaaaaaa", "日本語日本語日本", "zxqj" * 20):
        assert merger.tokens(text.encode()) == merger._by_heap(text.encode())


BOUNDS = [(0, 4, (0.85, 0.1, 0.05)), (1, 4, (0.85, 0.1, 0.05)), (1, 4, (1, 0, 0)), (0, 4, (0, 0, 1))]


@pytest.mark.parametrize("least,most,target", BOUNDS)
def test_rates_are_bounded_least_squares(spark, least, most, target):
    rng = np.random.default_rng(3)
    p, tokens = rng.dirichlet([2, 1, 0.3], 300), rng.integers(1, 500, 300)
    rows = [(int(t), *map(float, x)) for t, x in zip(tokens, p)] + [(0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "_tokens long, a double, b double, c double")
    found = mixing.fit_rates(df, ["a", "b", "c"], target, least, most)
    rated = df.withColumn("rate", mixing.Mixture.rate(found, [F.col(c) for c in "abc"])).toPandas()
    assert rated.rate.between(least, most).all() and len(rated) == 301
    got = np.array([(rated._tokens * rated.rate * rated[c]).sum() for c in "abc"])
    per_rate = (tokens[:, None] * p).T
    share, now = np.array(target) / sum(target), per_rate.sum(1)
    total = (now[share > 0] / share[share > 0]).max() if least >= 1 else now.sum()
    wanted, rate = share * total, np.ones(300)
    steepest = np.linalg.eigvalsh((p * tokens[:, None]).T @ p)[-1]
    for _ in range(20_000):
        rate = np.clip(rate - p @ (per_rate @ rate - wanted) / steepest, least, most)
    best = np.linalg.norm(per_rate @ rate - wanted)
    assert np.linalg.norm(got - wanted) <= best + 1e-3 * total
    assert np.allclose(found.missed, (got - wanted) / total, atol=2e-3)


def test_steps_of_the_fit_run_no_jobs(spark):
    rng = np.random.default_rng(5)
    p, tokens = rng.dirichlet([2, 1, 0.3], 3000), rng.integers(1, 500, 3000)
    rows = [(int(t), *map(float, x)) for t, x in zip(tokens, p)]
    df = spark.createDataFrame(rows, "_tokens long, a double, b double, c double")
    sc = spark.sparkContext
    sc.setJobGroup("steps of the fit", "")
    try:
        found = mixing.fit_rates(df, ["a", "b", "c"], (0.85, 0.1, 0.05), 1, 4)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(found.steps) > 5
    assert len(sc.statusTracker().getJobIdsForGroup("steps of the fit")) <= 3


def test_cells_of_the_fit_are_bounded():
    for size in range(1, 6):
        assert (mixing.grid_of(size) + 1) ** (size - 1) < 2 * mixing.MAX_CELLS
    assert mixing.grid_of(len(mixing.DOMAINS)) == mixing.GRID


def test_rates_refuse_bad_bounds(spark):
    df = spark.createDataFrame([], "_tokens long, a double, b double")
    for bounds in ({"target": (0, 0)}, {"target": (-1, 2)}, {"target": (1, 1), "least": 3, "most": 2}):
        with pytest.raises(ValueError):
            mixing.fit_rates(df, ["a", "b"], **bounds)
    assert mixing.fit_rates(df, ["a", "b"], (1, 1)).steps == ()


def test_pieces_apart_as_by_merging_anew():
    machine = pieces.Transducer(pieces.read_model(pieces.MODEL))
    rng = np.random.default_rng(11)
    ids = np.array(list(machine.ids.values()))
    short = ids[[len(machine.texts[i]) <= 3 for i in ids]]
    found = set()
    for a, b in [*rng.choice(short, (3000, 2)).tolist(), *rng.choice(ids, (1000, 2)).tolist()]:
        parts = [machine.texts[a], machine.texts[b]]
        found.add(apart := machine.may_follow(a, b))
        assert apart == (machine.merged("".join(parts)) == parts)
    assert found == {True, False}


def test_frequent_words_stay_known(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 20)
    machine = pieces.Transducer(pieces.read_model(pieces.MODEL))
    composed, path = [], machine.shortest_path
    monkeypatch.setattr(machine, "shortest_path", lambda word: composed.append(word) or path(word))
    words = " ".join(f"the w{i}q" for i in range(200))
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert machine.encode(words) == library.encode(words)
    assert composed.count(f"{pieces.SPACE}the") == 1
    assert len(machine.words) + len(machine.older) <= 20


def test_words_are_cut_where_no_piece_joins(monkeypatch):
    machine = pieces.Transducer(pieces.read_model(pieces.MODEL))
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    composed, path = [], machine.shortest_path
    monkeypatch.setattr(machine, "shortest_path", lambda word: composed.append(word) or path(word))
    text = "harbour, harbour. harbour! harbour"
    assert machine.encode(text) == library.encode(text)
    assert composed.count(f"{pieces.SPACE}harbour") == 1
    assert not [w for w in composed if "harbour" in w and w != f"{pieces.SPACE}harbour"]
    joined = {p[i : i + 2] for p in machine.ids for i in range(len(p) - 1)}
    odd = "a1b2,c  (d) naïve…«x»日本語据数据 一个\t\n  ½\u2581\u2581,\U0001f600\r\0é\u0301 الЖzЖ ¶¶ 10,000.50 "
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choices(odd, k=40))
        words = machine.cut(machine.prefix + text.replace(" ", pieces.SPACE))
        assert "".join(words) == machine.prefix + text.replace(" ", pieces.SPACE)
        assert not [w for w, v in zip(words, words[1:]) if w[-1] + v[0] in joined]
        assert machine.encode(text) == library.encode(text)
    groups = pieces.joined_characters(["ab", "bc", "de", "f", f"{pieces.SPACE}g"])
    assert [sorted(g) for g in groups] == [["a", "b", "c"], ["d", "e"], ["f"], ["g"]]
