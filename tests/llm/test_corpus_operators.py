"""The corpus operators on small tables, against brute force where there is no SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import chat, components, decontaminate, langid, mixing, ngram_join, quality, secret_scan, sharding, toxicity, url_rules

EDGES = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n ", None, "a"), (4, "x" * 200_000, "en", None), (4, "x" * 200_000, "en", None), (None, "null id here", "en", "a")]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---- components


def test_components_against_union_find(spark):
    draw = random.Random(3)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = components.connected_components(spark.createDataFrame(pairs + [(None, 5), (6, None), (7, 7)], "a long, b long"))
    assert rows(got, "node", "component") == sorted(((x, find(x)) for x in parent), key=repr)


# ---- n-gram Jaccard join


def brute_components(texts):
    sets = {}
    for doc, text in texts:
        w = (text or "").lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    component = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if sets[a] and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and component[a] < component[b]:
                    component[b], changed = component[a], True
    return sorted((d, len(sets[d]), component[d]) for d in ids)


def test_near_duplicates_against_brute_force(documents):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = [draw.choice(words) for _ in range(60)]
    texts = []
    for base in range(8):
        text = [draw.choice(words) for _ in range(draw.randrange(6, 120))]
        if base % 2:
            text += passage
        for _ in range(12):
            own = list(text)
            for _ in range(draw.randrange(0, 4)):
                own[draw.randrange(len(own))] = draw.choice(words)
            texts.append((len(texts), " ".join(own)))
    texts += [(500, "one two"), (501, "ONE two"), (502, "one"), (503, None), (504, " \n"), (505, "a b c d e"), (506, "a b c d e f")]
    got = ngram_join.near_duplicates(documents(texts))
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components(texts), key=repr)


@pytest.mark.parametrize("percent", [60, 90])
def test_near_duplicates_at_other_similarities(documents, percent):
    draw = random.Random(6)
    texts = []
    for _ in range(30):
        base = [f"u{draw.randrange(10**9)}" for _ in range(draw.randrange(20, 60))]
        texts.append((len(texts), " ".join(base)))
        texts.append((len(texts), " ".join(base[: 4 + round((len(base) - 4) * draw.uniform(0.5, 1))])))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in texts}
    likeness = {d: 100 * len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) for d in range(0, 60, 2)}
    expected = [(d, d if d % 2 == 0 or likeness[d - 1] < percent else d - 1) for d in range(60)]
    assert sum(60 <= x < 75 for x in likeness.values()) > 5
    assert rows(ngram_join.near_duplicates(documents(texts), percent), "doc_id", "component_id") == sorted(expected, key=repr)


def test_near_duplicates_edges(documents):
    got = rows(ngram_join.near_duplicates(documents(EDGES)), "doc_id", "n_shingles", "component_id")
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (None, 1, None)], key=repr)
    assert ngram_join.near_duplicates(documents([])).count() == 0
    kept = ngram_join.keep_one(documents(EDGES + [(9, "x" * 200_000)]))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 4]
    assert kept.columns == documents([]).columns


# ---- decontamination


def test_index_and_matches_against_brute_force(spark, documents):
    draw = random.Random(9)
    words = [f"t{i}" for i in range(30)]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([1, 3, 9, 10, 14])))) for i in range(25)] + [(90, None), (91, "!?"), (None, "t1 t2")]
    texts = [(d, " ".join(draw.choice(words) for _ in range(40)) + " " + (draw.choice(items)[1] or "") + " end") for d in range(60)]
    texts += [(100, None), (101, ""), (102, "T1, t2! ... T3")]
    found = decontaminate.find_leaks(documents(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").lower())
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in found}
    for doc, text in texts:
        ws, hit, names = split(text), set(), set()
        for item, t in items:
            iw = split(t)
            if item is None or not iw:
                continue
            for s in range(max(1, len(iw) - 9)):
                phrase = iw[s : s + 10]
                for i in range(len(ws) - len(phrase) + 1):
                    if ws[i : i + len(phrase)] == phrase:
                        hit |= set(range(i, i + len(phrase)))
                        names.add(item)
        assert got[doc] == (len(ws), len(hit), sorted(names)), doc


def test_proximity_and_blocks(spark, documents, monkeypatch):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon zeta")], "item_id long, text string")
    docs = documents([(1, "gamma x beta alpha"), (2, "alpha beta gamma"), (3, "alpha q q q q q q q q q q beta gamma"), (4, "delta epsilon zeta alpha beta gamma")])
    near = {r.doc_id: (sorted(r["items"]), sorted(r.near_items)) for r in decontaminate.find_leaks(docs, bench, slop=3).collect()}
    assert near == {1: ([], [1]), 2: ([1], [1]), 3: ([], []), 4: ([1, 2], [1, 2])}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3)
    split = {r.doc_id: sorted(r["items"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert split == {1: [], 2: [1], 3: [], 4: [1, 2]}


def test_blocks_unite_hit_words_and_keep_rows(spark, documents, monkeypatch):
    a, b = (" ".join(f"{x}{i}" for i in range(10)) for x in "ab")
    overlap = " ".join([f"a{i}" for i in range(5, 10)] + [f"c{i}" for i in range(5)])
    bench = spark.createDataFrame([(1, a), (2, b), (3, overlap)], "item_id long, text string")
    both, crossed = f"x {a} y {b} z", f"{a} " + " ".join(f"c{i}" for i in range(5))
    docs = documents([(1, both), (1, both), (None, both), (None, a), (2, crossed), (3, "none"), (3, "none"), (4, None)])
    answers = lambda: sorted(((r.doc_id or -1, r.n_words, r.n_hit, sorted(r["items"]), sorted(r.near_items)) for r in decontaminate.find_leaks(docs, bench, slop=1).collect()))
    whole = answers()
    assert [(r[0], r[2], r[3]) for r in whole] == [(-1, 10, [1]), (-1, 20, [1, 2]), (1, 20, [1, 2]), (1, 20, [1, 2]), (2, 15, [1, 3]), (3, 0, []), (3, 0, []), (4, 0, [])]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    assert answers() == whole


def test_decontamination_edges(spark, documents):
    bench = spark.createDataFrame([(1, "null id here")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(documents([*EDGES, (8, "null ID here")]), bench)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 4]
    assert decontaminate.find_leaks(documents([]), bench).count() == 0
    assert [r.n_hit for r in decontaminate.find_leaks(documents([(1, "a b")]), bench.limit(0)).collect()] == [0]


# ---- language identification


def plain_walk(mine, text):
    """Bits of a text under one language's counts, order by order."""
    padded, bits = b"   " + bytes(langid.FOLD[list(text.encode())]), 0.0
    for j in range(3, len(padded)):
        for order in (3, 2, 1, 0):
            after = Counter()
            for g, n in mine.items():
                if g[3 - order : 3] == padded[j - order : j]:
                    after[g[3]] += n
            total, kinds = sum(after.values()), len(after)
            if total == 0:
                continue
            if after[padded[j]]:
                bits -= np.log2(after[padded[j]] / (total + kinds))
                break
            bits -= np.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("group", [1, 2, 8])
def test_code_lengths_against_plain_walk(group):
    import pyarrow as pa

    texts = {
        "aa": "the cat and the hat sat on the mat", "bb": "der hund und der mond sind rund", "cc": "кот и пёс спят на крыше",
        "dd": "猫と犬は屋根の上で眠る", "ee": "the hound and the moon",
    }
    counts = {lang: Counter() for lang in texts}
    for lang, text in texts.items():
        padded = b"   " + bytes(langid.FOLD[list(text.encode())])
        for j in range(3, len(padded)):
            counts[lang][padded[j - 3 : j + 1]] += 1
    flat = [(i, int.from_bytes(g, "big"), n) for i, lang in enumerate(texts) for g, n in counts[lang].items()]
    lang, gram, n = map(np.array, zip(*flat))
    trees = langid.build_trees(list(texts), lang, gram, n, group)
    tests = ["the mat and the rat", "der HUND", "sun", "", "пёс и кот", "犬と猫", "q\x00é", None, *texts.values()]
    for size in (1, 7, 1 << 17):
        got = trees.code_lengths(pa.array(tests), size)
        for text, bits in zip(tests, got):
            assert bits == pytest.approx([plain_walk(counts[k], text or "") for k in texts], rel=1e-4, abs=1e-3)


def test_fifty_languages_of_three_scripts(documents):
    draw = random.Random(6)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "अआइईउऊएऐओऔकखगघचछजझटठडढतथदधनपफबभमयरलवशषसह"]
    words = {f"l{i:02}": ["".join(draw.choice(scripts[i % 3]) for _ in range(draw.randrange(2, 7))) for _ in range(30)] for i in range(50)}
    rows = [(100 * i + j, " ".join(draw.choice(w) for _ in range(40)), lang) for i, (lang, w) in enumerate(words.items()) for j in range(12)]
    docs = documents(rows)
    got = langid.identify(docs, langid.train(docs)).where("held_out").collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) > 100 and all(r.lang_pred == truth[r.doc_id] for r in got)


def test_language_edges(documents):
    docs = documents([(i, "the cat and the dog are in the house", "en") for i in range(20)] + [(100 + i, "der hund und die katze im haus", "de") for i in range(20)] + EDGES + [(8, "12 34 !")])
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert got[0].lang_pred == "en" and got[100].lang_pred == "de" and got[4].lang_pred in ("en", "de")
    assert {got[i].lang_pred for i in (1, 2, 3, 8)} == {"und"} and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = documents([])
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert [r.lang_pred for r in langid.identify(documents([(1, "word")]), langid.train(empty)).collect()] == ["und"]


# ---- toxicity


def test_toxicity_tolerates_gaps_and_insertions(spark, documents):
    draw = random.Random(1)
    syllables = ["ta", "ro", "mi", "len", "sor", "ve", "du", "pa"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4)))
    insults = ["blixgrak", "quozzel", "frubnik"]
    texts, labels = [], []
    for i in range(240):
        ws = [word() for _ in range(draw.randrange(5, 40))]
        if i % 3 == 0:
            ws[draw.randrange(len(ws))] = draw.choice(insults)
        texts.append((i, " ".join(ws)))
        labels.append((i, int(i % 3 == 0)))
    texts += [(1000, "ta ro blixxgrak mi"), (1001, "ta q.u.o.z.z.e.l mi"), (1002, "len f r u b n i k sor"), (1003, "ta ro mi len")] + [(2000 + i, t) for i, (_, t, *_) in enumerate(EDGES)]
    docs = documents(texts)
    model = toxicity.train(docs, spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r.toxicity for r in toxicity.with_toxicity(docs, model).collect()}
    assert sum((got[i] >= 0.7) != (i % 3 == 0) for i in range(240)) <= 3
    assert [got[i] >= 0.7 for i in (1000, 1001, 1002, 1003)] == [True, True, True, False]
    assert not any(got[2000 + i] >= 0.7 for i in range(len(EDGES)))
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.toxicity <= 1 for r in toxicity.with_toxicity(documents([(1, None)]), none).collect())
    assert toxicity.with_toxicity(documents([]), model).count() == 0


def test_insults_of_a_second_script_and_a_wide_alphabet(monkeypatch):
    draw = random.Random(11)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "".join(chr(0x4E00 + i) for i in range(200))]
    clean = [["".join(draw.choice(s) for _ in range(draw.randrange(4, 8))) for _ in range(150)] for s in scripts]
    insults = [["".join(draw.choice(s) for _ in range(7)) for _ in range(4)] for s in scripts]

    def text(toxic, script):
        return {*draw.sample(clean[script], 12), *([draw.choice(insults[script])] if toxic else [])}

    positive = [text(True, i % 3) for i in range(240)]
    negative = [text(False, i % 3) for i in range(240)]
    shared = Counter(w for bag in negative for w in bag)
    got = []
    for dense in (toxicity.DENSE_TRIPLES, 0):
        monkeypatch.setattr(toxicity, "DENSE_TRIPLES", dense)
        model = toxicity.fit(positive, negative, dict(shared))
        margins = [model.margins(words) for words in (*insults, *clean)]
        assert all(bad.min() > good.max() for bad, good in zip(margins[:3], margins[3:]))
        got.append(np.concatenate(margins))
    assert np.allclose(got[0], got[1])


def test_leaders_of_hot_and_rare_hashes(spark):
    rng = random.Random(4)
    sets = [(rep, rng.randint(8, 12), [0 if rng.random() < 0.4 else rng.randrange(400) for _ in range(6)]) for rep in range(3_000)]
    able = spark.createDataFrame(sets, "rep long, n long, keys array<long>")
    least, wanted = {}, set()
    for rep, n, keys in sets:
        for at in enumerate(keys):
            lead, size = least.setdefault(at, (rep, n))
            if lead != rep and 100 * min(n, size) >= 75 * max(n, size):
                wanted.add((lead, rep))
    assert rows(ngram_join.leader_pairs(able), "a", "b") == sorted(wanted, key=repr)


def test_equal_postings_of_one_set_count_as_shared():
    tokens = [np.array([8, 9, 10, 1 << 50], np.uint64), np.array([1 << 51], np.uint64)]
    found = [r for batch in ngram_join._packed(tokens, [5, 6], 2) for r in batch.to_pylist()]
    assert [(r["mark"], r["shared"]) for r in found if r["postings"] is None] == [(5, 2)]
    assert sum(len(r["postings"]) // 8 for r in found if r["postings"]) == 3


# ---- sharding


def plain_best_fit(sizes, capacity):
    """Item by item, every bin looked at."""
    rooms, bins = [], []
    for size in sorted(sizes, reverse=True):
        fitting = [(room, at) for at, room in enumerate(rooms) if room >= size]
        if fitting:
            at = min(fitting)[1]
        else:
            at = len(rooms)
            rooms.append(max(capacity, size))
        rooms[at] -= size
        bins.append((size, at))
    return bins, len(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_decreasing_against_plain_search(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, rng.choice([3, 20, 130])) for _ in range(rng.choice([1, 30, 400]))]
    wanted, opened = plain_best_fit(sizes, 100)
    runs, bins = sharding.best_fit_decreasing(sorted(Counter(sizes).items()), 100)
    assert [(size, at) for size, at, _, count in runs for _ in range(count)] == wanted and bins == opened
    assert sharding.best_fit_decreasing(sorted(Counter(sizes).items()), 100, opened - 1) is None
    ranks = defaultdict(list)
    for size, _, first, count in runs:
        ranks[size] += range(first, first + count)
    assert ranks == {size: list(range(n)) for size, n in Counter(sizes).items()}


@pytest.mark.parametrize("seed", range(10))
def test_open_bins_against_a_sorted_list(seed):
    rng, tree, plain = random.Random(seed), sharding.OpenBins(), []
    for at in range(3_000):
        if rng.random() < 0.55:
            plain.append((rng.randint(1, 300), at))
            tree.add(plain[-1])
        else:
            size = rng.randint(1, 320)
            best = min((b for b in plain if b[0] >= size), default=None)
            assert tree.take_tightest(size) == best
            if best:
                plain.remove(best)

    def depth(node):
        return 1 + max(depth(node.left), depth(node.right)) if node else 0

    assert depth(tree._root) <= 2 * len(plain).bit_length() + 1


def test_packed_capacity_is_feasible_and_near_the_mean():
    rng = random.Random(3)
    sizes = Counter(rng.randint(1, 2_000) for _ in range(5_000)) + Counter([40_000] * 3)
    total = sum(s * n for s, n in sizes.items())
    runs, capacity = sharding.pack_into(sorted(sizes.items()), 16)
    loads = Counter()
    for size, at, _, count in runs:
        loads[at] += size * count
    assert set(loads) <= set(range(16)) and sum(loads.values()) == total
    assert max(loads.values()) <= capacity <= total / 16 + 2
    assert sharding.pack_into([], 16) == ([], 0)
    assert sharding.pack_into([(7, 3)], 2)[1] == 14


def test_shards_hold_hot_texts_whole_and_even_bytes(documents):
    docs = documents([(i, "hot text" if i % 3 == 0 else f"text {i} " * (i % 11)) for i in range(3_000)] + [(None, "n")] * 50)
    got = sharding.assign_shards(docs, 5).collect()
    assert len(got) == 3_050
    by_text, loads, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        by_text[r.text_crc32].add(r.shard)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values()) and len(loads) == 5
    assert max(loads.values()) - min(loads.values()) <= 5
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_keep_groups_and_count_slots(documents):
    docs = documents([(i, f"text {i % 40} " * (i % 7 + 1)) for i in range(400)] + EDGES)
    got = sharding.assign_shards(docs, 4).collect()
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in got:
        by_shard[r.shard].append(r.slot)
        by_text[r.text_crc32].add(r.shard)
    assert len(got) == 406 and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in by_text.values())
    assert sharding.assign_shards(documents([])).count() == 0


# ---- mixing


def test_exponent_meets_targets():
    tokens = [1000, 100, 10]
    exponent = mixing.bisect_exponent(tokens, repeat_limit=4.0)
    assert mixing.most_repeats(tokens, exponent) == pytest.approx(4.0, rel=1e-6)
    middle = mixing.entropy(mixing.tempered(tokens, 0.5))
    assert mixing.bisect_exponent(tokens, target_entropy=middle) == pytest.approx(0.5, abs=1e-9)
    assert mixing.bisect_exponent([5]) == 1.0 and mixing.bisect_exponent([]) == 1.0


def test_stream_meets_weights_and_loses_nothing(documents):
    docs = documents([(i, "w " * (i % 5 + 1), "en", "big" if i % 10 else "small") for i in range(10, 1010)] + EDGES)
    stream = mixing.mixed_stream(mixing.sized(docs.where("doc_id is not null")).distinct(), repeat_limit=3.0, block_tokens=200).collect()
    uses = Counter(r.row for r in stream)
    assert set(uses) == {r.doc_id for r in docs.collect() if r.doc_id is not None} and max(uses.values()) <= 3
    total = sum(r.tokens for r in stream)
    share, weight = Counter(), {}
    for r in stream:
        share[r.source] += r.tokens
        weight[r.source] = r.weight
    assert all(abs(share[s] / total - weight[s]) < 0.01 for s in ("big", "small"))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in docs.collect()}
    assert mixing.mix_documents(documents([])).count() == 0


def test_uses_are_counted_per_row(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _again int, row_key string, row_uses long, tokens long, key long"
    common = [(i, "w " * 30, "en", "big", 1, i, "k", 9, 1, 2) for i in range(300)]
    rare = [(5000, f"rare {i}", "en", "rare", 1, 0, "k", 9, 1, 2) for i in range(3)] + [(None, "no id", "en", "rare", 1, 0, None, 9, 1, 2)]
    same = [(7000, "same", "en", "rare", 1, 0, "k", 9, 1, 2)] * 5
    docs = spark.createDataFrame(common + rare + same, schema)
    mixed = mixing.mix_documents(docs, repeat_limit=2.0)
    assert mixed.columns == docs.columns
    got = Counter(tuple(r) for r in mixed.collect())
    assert set(got) == set(common + rare + same)
    assert all(got[r] in (1, 2) for r in common + rare) and 5 <= got[same[0]] <= 10
    assert sum(got[r] for r in rare) + got[same[0]] > 9


def test_stream_is_permutations_cut_at_budgets(documents):
    docs = mixing.sized(documents([(i, "w " * (i % 7), "en", f"s{i % 3 if i % 10 else 9}") for i in range(700)]))
    weights = {r.source: r for r in mixing.source_weights(docs.select("source", "tokens"), repeat_limit=2.5).collect()}
    stream = mixing.mixed_stream(docs, repeat_limit=2.5, block_tokens=300).collect()
    sizes = {r.row: r.tokens for r in docs.collect()}
    for source, plan in weights.items():
        own = [r for r in stream if r.source == source]
        epochs = {}
        for r in own:
            epochs.setdefault(r.epoch, []).append(r.row)
        full = [r.row for r in docs.collect() if r.source == source]
        last = max(epochs)
        for epoch, used in epochs.items():
            assert len(set(used)) == len(used)
            assert epoch == last or sorted(used) == sorted(full)
        budget = plan.epochs * plan.tokens
        used = sum(sizes[r.row] for r in own)
        assert budget <= used + 1e-6 and used < budget + max(sizes.values())
        per_block = Counter()
        for r in own:
            per_block[r.block] += r.tokens
        share = plan.weight * 300
        assert all(abs(n - share) <= 2 * max(sizes.values()) for b, n in per_block.items() if b < max(per_block))


# ---- chat


def test_layouts_select_their_mapping(spark):
    def one(text):
        record = F.from_json(F.lit(text), F.schema_of_json(F.lit(text)))
        return chat.canonical_turns(spark.range(1).select(record.alias("r")).select("r.*")).first()

    told = lambda r: [(t.role, t.text) for t in r.turns]
    assert told(one('{"prompt":"p","completion":"c","id":"7"}')) == [("user", "p"), ("assistant", "c")]
    assert told(one('{"instruction":"i","input":"x","output":"o"}')) == [("user", "i\n\nx"), ("assistant", "o")]
    assert told(one('{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}')) == [("user", "h"), ("assistant", "g")]
    assert one('{"other":"p"}').turns is None
    assert one('{"prompt":"p","response":"c"}').fingerprint == chat.fingerprint_of(("response", "prompt"))


def test_formatting_round_trips(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\b\\h\\l\\c", "", None, "a: b\n</turn>\n### x: ", "#<\\:", "é\n\n"]
    given = [(1, i, "assistant" if i % 2 else "us: er", t) for i, t in enumerate(nasty)] + [(2, 0, None, "t"), (None, 0, "assistant", "n")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(given, "conv_id long, turn long, role string, text string")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "us: er", t or "") for i, t in enumerate(nasty)]
    loss = "".join(got[1].formatted[s.start - 1 : s.start - 1 + s.length] for s in got[1].loss_spans)
    for code, plain in (("\\h", "#"), ("\\l", "<"), ("\\c", ":"), ("\\b", "\\")):
        loss = loss.replace(code, plain)
    assert loss == "".join(t or "" for i, t in enumerate(nasty) if i % 2)
    assert [t.role for t in got[2].turns] == [""] and len(got[None].turns) == 1


def test_spans_of_many_turns(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} # <" * (t % 3)) for t in range(3000)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert [t.text for t in got.turns] == [r[3] for r in rows] and len(got.loss_spans) == 1500
    for span, row in zip(got.loss_spans, [r for r in rows if r[2] == "assistant"]):
        held = got.formatted[span.start - 1 : span.start - 1 + span.length]
        assert held.replace("\\h", "#").replace("\\l", "<") == row[3]
    none = chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert none.collect() == []


# ---- URLs


def test_rules_and_redirects(spark):
    pages = [(1, "http://A.B.example.net/en/x?q", None), (2, "http://a.net/en/", None), (3, "https://x.example.com/de/1", None), (4, "http://m.org/fr/2", None),
             (5, "http://alias.io/p", '<link rel="canonical" href="http://a.net/en/">'), (6, "http://alias2.io/p", '<meta http-equiv="refresh" content="0; url=http://alias.io/p">'),
             (7, "http://both.io/", '<link rel="canonical" href="http://m.org/fr/2"><meta property="og:url" content="http://a.net/en/">'), (8, None, None), (9, "no scheme", "x"), (10, "http://net/", None), (10, "http://net/", None), (11, "http://safe.io", None)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.b.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("a.net", "/en/", "net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    # 7 joins the class of 5 and 6 with an allowed member, which takes precedence.
    assert [got[i][3] for i in (5, 6, 7)] == ["allow"] * 3
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow") and got[10][3] == "block" and got[11][3] == "allow"
    blocked = {r.page_id: r.verdict for r in url_rules.judged(spark.createDataFrame(pages[:6], "page_id long, url string, html string")).collect()}
    assert blocked[5] == blocked[6] == "block"


def test_links_of_every_form_against_urljoin(spark):
    from urllib.parse import urljoin

    pages = ["http://h.io", "http://h.io/", "https://h.io/a", "http://h.io/a/b/c.html?q=1#f", "http://h.io/a/b/"]
    links = ["http://x.io/p?q", "HTTPS://X.io", "//x.io/p/", "/p", "/a/../p/./q", "p.html", "./p", "../p", "../../../p", "p/..", "?id=1", "p?id=/../1", "#top", "", "mailto:a@b.c", "javascript:x()", "a/b:c"]
    rows = [(u, t) for u in pages for t in links]
    made = spark.createDataFrame(rows, "url string, target string").select("url", "target", url_rules.resolved(F.col("target"), F.col("url")).alias("got"))
    for r in made.collect():
        want = None if r.target.startswith(("mailto:", "javascript:")) else urljoin(r.url, r.target).split("#")[0]
        got = None if r.got is None else r.got.split("#")[0]
        if want is not None and want.count("/") == 2:
            want += "/" if got.endswith("/") else ""
        assert (got or "").lower() == (want or "").lower(), (r.url, r.target)


def test_aliases_against_union_find(spark):
    from urllib.parse import urljoin

    draw = random.Random(12)
    hosts = ["a.net", "www.a.net", "b.io", "m.org", "www.io", "m.io", "org", "io", "c.example.com"]
    urls = [f"http://{h}/{p}" for h in hosts for p in ("", "de/x", "en/y", "fr/z", "d/index.html", "d/")]
    forms = ["/en/y", "../de/x", "//b.io/en/y", "z.html", "?id=1", "http://a.net/fr/z"]
    pages = []
    for i in range(150):
        links = "".join(f'<link rel="canonical" href="{draw.choice(forms)}">' for _ in range(draw.choice([0, 0, 0, 1])))
        pages.append((i, draw.choice(urls), links))
    def spelled(url):
        host, _, path = url.split("://", 1)[1].partition("/")
        path, _, asked = f"/{path}".partition("?")
        host = host[4:] if host.startswith("www.") and "." in host[4:] else host
        path = re.sub(r"/index\.html$", "/", path)
        return host + re.sub(r"/+$", "", re.sub(r"\.html$", "", path)) + (f"?{asked}" if asked else "")

    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, url, html in pages:
        for target in re.findall('href="([^"]+)"', html):
            parent[find(spelled(url))] = find(spelled(urljoin(url, target)))
    def rule(url):
        host, _, path = url.split("://", 1)[1].partition("/")
        fits = [r for r in url_rules.RULES if (host == r[0] or host.endswith("." + r[0])) and f"/{path}".startswith(r[1])]
        return max(fits, key=lambda r: len(r[0]) + len(r[1]))[2] if fits else None

    classes = {}
    for _, url, _ in pages:
        classes.setdefault(find(spelled(url)), set()).add(rule(url))
    want = {}
    for i, url, _ in pages:
        held = classes[find(spelled(url))] - {None}
        want[i] = rule(url) or ("allow" if "allow" in held or not held else "block")
    got = url_rules.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.verdict for r in got} == want and set(want.values()) == {"allow", "block"}
    same = {}
    for r in got:
        same.setdefault(find(spelled(pages[r.page_id][1])), set()).add(r.alias_class)
    assert all(len(c) == 1 for c in same.values()) and len({c for s in same.values() for c in s}) == len(same)
    assert url_rules.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- layouts of any depth


def test_nested_layouts(spark):
    """Paths below lists in structs select their mapping; parts are joined, parts without text left out."""
    part = "struct<type:string,text:string>"
    schema = (
        f"id int, messages array<struct<role:string,content:array<{part}>>>, "
        f"data struct<messages:array<struct<role:string,content:array<{part}>>>,extra:int>, prompt string, completion string"
    )
    turns = [("human", [("text", "Look: "), ("image", None), ("text", "a # b")]), ("gpt", [("text", "Yes.")])]
    rows = [
        (1, turns, None, None, None), (2, None, (turns, 7), None, None), (3, None, None, "q", "a"),
        (4, turns, (turns, 7), None, None), (5, None, None, None, None), (6, [("human", None)], None, None, None),
        (7, [], None, None, None),
    ]
    got = {r.id: r for r in chat.canonical_turns(spark.createDataFrame(rows, schema)).collect()}
    expected = [("user", "Look: a # b"), ("assistant", "Yes.")]
    assert [tuple(t) for t in got[1].turns] == expected == [tuple(t) for t in got[2].turns]
    assert got[1].fingerprint == chat.fingerprint_of(("messages[].content[].text", "messages[].role"))
    assert got[2].fingerprint == chat.fingerprint_of(("data.messages[].content[].text", "data.messages[].role"))
    assert [tuple(t) for t in got[3].turns] == [("user", "q"), ("assistant", "a")]
    assert all(got[i].turns is None for i in (4, 5, 6, 7))
    paths = {p for p, _ in chat.filled_paths(spark.createDataFrame([], schema).schema)}
    assert {"data.messages[].content[].type", "data.extra", "messages[].role", "prompt"} <= paths
    assert chat.canonical_turns(spark.createDataFrame([], schema)).count() == 0


# ---- quality


def test_binomial_tail(spark):
    from math import comb

    cases = [(k, n) for n in (1, 5, 60, 400) for k in (0, 1, n // 3, n)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.1).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(sum(comb(r.n, i) * 0.1**i * 0.9 ** (r.n - i) for i in range(r.k + 1)), rel=1e-9)
    large = spark.createDataFrame([(100, 100_000)], "k long, n long").select(quality.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).first()
    assert 0 <= large.p < 1e-100


def test_thresholds_limit_false_rejections(spark, documents):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(600)]
    bad = [(1000 + i, " ".join(f"###### w{i}x{j}" for j in range(60)), "en") for i in range(50)]
    labels = spark.createDataFrame([(i, 1) for i in range(600)] + [(1000 + i, 0) for i in range(50)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judged(documents(good + bad + EDGES + [(2000, "###### " * 60, "xx")]), labels).collect()}
    assert all(got[i].kept for i in range(600)) and not any(got[1000 + i].kept for i in range(50))
    assert got[1000].rejected_by == ["symbol_rate"] and got[1].n_words == 60
    assert [got[i].base_failed for i in (None, 2000)] == [True, True]
    assert quality.judged(documents([]), labels).count() == 0
    nothing = quality.judged(documents(bad), labels.limit(0)).collect()
    assert all(r.kept for r in nothing)


def test_threshold_steps(spark, documents):
    """Every stratum ends at the last step proved in order, as summed in Python; ties pass, repeats count once."""
    from math import comb

    words = " ".join(f"w{j}" for j in range(100))
    # Of stratum aa, 20 good texts have a symbol rate of 0.3: steps that reject above 0.2 see too many.
    rows = [(i, words + (" " + "#" * 30 if i < 20 else ""), "aa") for i in range(400)]
    rows += [(1000 + i, words, None) for i in range(200)] * 2 + [(2000 + i, words, "few") for i in range(50)]
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    measured = quality.measured(documents(rows))
    got = {r.stratum: r for r in quality.thresholds(measured, labels).collect()}
    assert {k: r.n_good for k, r in got.items()} == {"aa": 400, "": 200, "few": 50}
    for r in got.values():
        tails = [sum(comb(r.n_good, i) * 0.04**i * 0.96 ** (r.n_good - i) for i in range(k + 1)) for k in r.step_rejected]
        proved = [t <= 0.05 / 3 for t in tails] + [False]
        assert r.step == proved.index(False)
    assert (got["aa"].step, got[""].step, got["few"].step) == (4, 7, 0)
    assert got["few"].limit_symbol_rate is None and got["aa"].limit_symbol_rate == 0.3
    kept = {r.doc_id: r.kept for r in quality.judged(documents(rows + [(1, words + " " + "#" * 90, "aa")]), labels).collect() if r.doc_id > 1}
    assert all(kept.values())


# ---- secrets


def test_secret_scan(documents):
    draw = random.Random(4)
    token = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(draw.choice(a) for _ in range(n))
    texts = []
    for i in range(300):
        kind = (f"password={token(18, '0123456789abcdef')}", f"AKIA{token(15)}7", f"call 4{token(15, '0123456789')}", f"mail user{i}12345@mail1.example.com")[i % 4]
        texts.append((i, f"some words before {kind} and words after", "en", f"s{i % 3}"))
    got = secret_scan.scan(documents(texts + [(900 + i, t) for i, (_, t, *_) in enumerate(EDGES)])).collect()
    found = {(r.doc_id, r.place): r.is_secret for r in got}
    assert all(found[i, 3] for i in range(300) if i % 4 < 2)
    assert not any(found[i, 4] for i in range(300) if i % 4 >= 2)
    assert secret_scan.scan(documents([])).count() == 0 and secret_scan.scan(documents([(1, "plain words only")])).count() == 0
    assert next(r for r in got if r.doc_id == 0).word_sha256 == hashlib.sha256(texts[0][1].split()[3].partition("=")[2].encode()).hexdigest()


def test_secret_scan_finds_marked_letter_only_and_short_secrets(documents):
    draw = random.Random(8)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz"
    token = lambda n, a: "".join(draw.choice(a) for _ in range(n))
    texts, secrets = [], {}
    for i in range(360):
        key, letters, short = f"AKIA{token(15, upper)}7", token(14, lower), token(4, lower) + token(4, "0123456789")
        kind, at, value = (
            (f"see \u201c{key}\u201d.", 1, key), (f"see {key}\u2026", 1, key), (f"password={letters}", 0, letters), (f"token = {letters}", 2, letters),
            (f"password = {short}", 2, short), (f'{{"api_key":"{letters}"}}', 0, f'"{letters}"}}'), (f"password=\u201e{letters}\u201c", 0, letters),
            (f"call 4{token(15, '0123456789')}", 1, None), (f"Author: Shakespeare on 2024-01-{10 + i % 20}", 1, None),
        )[i % 9]
        texts.append((i, f"some words before {kind} and words after", "en", f"s{i % 3}"))
        secrets[i] = (3 + at, value)
    texts += [(900, "1" + "\u2550" * 100_000 + "x"), (901, "\u2550" * 100_000 + "1")]
    found = {(r.doc_id, r.place): (r.is_secret, r.word_sha256) for r in secret_scan.scan(documents(texts)).collect()}
    for i, (place, value) in secrets.items():
        if value is None:
            assert not found[i, place][0], texts[i]
        else:
            assert found.get((i, place)) == (True, hashlib.sha256(value.encode()).hexdigest()), texts[i]
