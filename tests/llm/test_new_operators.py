"""Packing, conversation repair and the Merkle manifest against brute force."""

import itertools
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiloom.llm import merkle, packing, repair

EDGES = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n ", None, "a"), (4, "xy" * 60_000, "en", None), (4, "xy" * 60_000, "en", None), (None, "null id here", "en", "a")]


# ---- packing


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_gives_the_reference_ids(reference, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 200)
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(4)
    letters = [*"ab é ß\n\t 12'st.,!ñ漢字    \x85\x1c\xa0😀", "<|endoftext|>", " the", "'ll", "'S", "x" * 50, " " * 70]
    for n in [0, 1, 2, 7, 60, 600, 600, 600]:
        for _ in range(20):
            text = "".join(draw.choice(letters) for _ in range(n))
            assert encoder.ids(text).tolist() == [*reference.encode(text, add_special_tokens=False).ids, packing.END_TOKEN]


def test_long_runs_are_encoded(reference):
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("x" * 150_000, " " * 150_000, "\n" * 70_000 + "a b"):
        assert encoder.ids(text).tolist()[:-1] == reference.encode(text, add_special_tokens=False).ids


def squares(counts, window):
    return sum(n * n for level, n in counts.items() if 0 < level < window and not packing.is_power(level))


def test_every_choice_has_the_least_squares():
    draw, window = random.Random(8), 37
    state = packing.SumOfSquares(window, max_open=10**6)
    for doc in range(400):
        length = draw.choice([draw.randrange(1, window), 20, 21, 5])
        before = {level: len(held) for level, held in enumerate(state.open)}
        options = []
        for level in range(window - length + 1):
            if level == 0 or before[level]:
                counts = dict(before)
                counts[level] -= level > 0
                counts[level + length] = counts.get(level + length, 0) + 1
                options.append((squares(counts, window), -level))
        assert (state.level_for(length)) == -min(options)[1]
        state.add(doc, np.zeros(length, "<u4"))


@pytest.mark.parametrize("max_open", [3, 10**6])
def test_no_token_lost_and_no_padding(max_open):
    draw, window = random.Random(max_open), 64
    state = packing.SumOfSquares(window, max_open)
    docs = [np.arange(draw.choice([1, 40, draw.randrange(1, 300)])).astype("<u4") for _ in range(300)]
    for doc, ids in enumerate(docs):
        state.add(doc, ids)
        assert state.counts.sum() <= max_open
    state.settle()
    found = {}
    for sequence in state.done:
        length = sum(len(p.ids) for p in sequence)
        assert length == window or packing.is_power(length)
        for p in sequence:
            found.setdefault(p.doc_id, []).append((p.start, p.ids))
    for doc, ids in enumerate(docs):
        assert np.concatenate([i for _, i in sorted(found[doc], key=lambda x: x[0])]).tolist() == ids.tolist()


def test_pack_reads_back(spark, documents, reference):
    draw = random.Random(2)
    texts = EDGES + [(i, " ".join(draw.choice(["alpha", "b", "ç", "1 2"]) for _ in range(draw.randrange(900)))) for i in range(10, 60)]
    got = packing.pack(documents(texts).repartition(3), window=256, max_open=8).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0) and len(r.ids) == 4 * r.length
        filled[r.sequence_id] = r.offset + r.length
    lengths = {r.sequence_id: r.sequence_length for r in got}
    assert lengths == filled and all(n == 256 or packing.is_power(n) for n in filled.values())
    pieces = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.start), []).append(r)
    for doc, text, *_ in texts:
        want = [*reference.encode(text or "", add_special_tokens=False).ids, 1]
        copies = sum(1 for t in texts if t[0] == doc)
        own = [r for key, rows in pieces.items() if key[0] == doc for r in rows]
        assert sum(r.length for r in own) == copies * len(want) and {r.doc_tokens for r in own} == {len(want)}
        for r in own:
            assert np.frombuffer(r.ids, "<u4").tolist() == want[r.start : r.start + r.length]
    assert packing.pack(documents(texts).limit(0)).collect() == []


# ---- Merkle manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Levels of a tree over 16-runs, the lowest first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i : i + 16]) for i in range(0, len(low), 16)])
    return levels


def way(levels, i):
    steps = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        steps.append((run[: i % 16], run[i % 16 + 1 :]))
        i //= 16
    return steps


def brute_manifest(rows):
    def leaf(r, text):
        return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in (r[0], r[3], r[2], r[4], text)))

    sources = {}
    for r in rows:
        low = r[1] and re.sub("[A-Z]", lambda m: m.group().lower(), r[1])
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        sources.setdefault(r[3], []).append((r[0], leaf(r, r[1]), leaf(r, low) if changed else leaf(r, r[1])))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in sources[s]])
    top = tree([trees[s][-1][0] for s in names])
    found = []
    for n, s in enumerate(names):
        for i, (doc, own, changed) in enumerate(sources[s]):
            steps = way(trees[s], i) + way(top, n)
            fold = changed
            for before, after in steps:
                fold = h(*before, fold, *after)
            proof = h(*(x for before, after in steps for x in (*before, *after)))
            found.append((doc, own, trees[s][-1][0], top[-1][0], proof, fold, fold == top[-1][0]))
    return sorted(found, key=repr)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string, key string, leaf string"


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {None: 1, "a": 16, "b": 17}, {"A": 9000, "b": 256, "é": 4096, None: 3, "": 257}, {f"s{i}": 1 + i % 3 for i in range(300)},
])
def test_manifest_against_brute_force(spark, sizes):
    rows, draw = [], random.Random(1)
    for source, n in sizes.items():
        for _ in range(n):
            doc = draw.randrange(10**9)
            rows.append((doc, draw.choice(["Abc É", "lower", "", None, f"T{doc}"]), draw.choice(["en", None]), source, draw.choice([3, None]), "x", "y", "z"))
    rows += [(None, "no id", "en", "a", 1, "x", "y", "z"), (None, "No id", "en", "a", 1, "x", "y", "z"), (5, "Rep", "en", "a", 1, "x", "y", "z"), (5, "Rep", "en", "a", 1, "x", "y", "z")]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_manifest(rows)


def test_manifest_of_edges(spark, documents):
    rows = [(*r, None) for r in EDGES]
    got = merkle.manifest(documents(EDGES)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(rows)
    assert merkle.manifest(documents(EDGES).limit(0)).collect() == []
    one = merkle.manifest(documents(EDGES[:1])).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h() and one.verified


# ---- conversation repair


def brute_damage(rows):
    def order(r):
        return (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())

    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        c, t = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        held += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(held, key=order) for c, held in out.items()}


def brute_faults(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    return faults


def brute_repair(rows, faults):
    """Every useful edit sequence, kept as the least (cost, audit) of a repaired role string's class."""

    def state(roles):
        if re.fullmatch("(s?(ua)*)?", roles):
            return ("s" if roles == "s" else "a" if roles else "")
        return "u" if re.fullmatch("s?(ua)*u", roles) else None

    best = {"": (0, "", "", [])}

    def keep(new, roles, cost, audit, lines):
        at = state(roles)
        if at is not None and (at not in new or (cost, audit) < new[at][:2]):
            new[at] = (cost, audit, at if at != "a" else "ua", lines)

    def inserted(best):
        for _ in range(3):
            new = dict(best)
            for _at, (cost, audit, roles, lines) in best.items():
                for role in ("user", "assistant"):
                    keep(new, roles + role[0], cost + 5, audit + "I", [*lines, f"{role}:"])
            best = new
        return best

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        for _at, (cost, audit, roles, lines) in inserted(best).items():
            keep(new, roles, cost + 2, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                keep(new, roles + (role[:1] or "?"), cost + more, audit + "K", [*lines, f"{role}:{text}"])
                for other in ("user", "assistant"):
                    keep(new, roles + other[0], cost + more + 1, audit + "R", [*lines, f"{other}:{text}"])
        best = new
    cost, audit, _, lines = min(x for at, x in inserted(best).items() if at in ("", "a"))
    return cost, audit, sha256("\n".join(lines).encode()).hexdigest()


def brute_report(rows):
    found = []
    for conv, held in brute_damage(rows).items():
        faults = brute_faults(held)
        turns = [r[1] for r in held if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(held)]
        found.append((
            conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), *brute_repair(held, faults),
        ))
    return sorted(found, key=repr)


CONVERSATIONS = "conv_id long, turn long, role string, text string, slice string, fault string"


def drawn_conversations(draw, n, longest):
    texts = ["One. Two!", "No end", "Fine.", " \t\n", "", None, "Ends? \n", "é.", "same.", "x" * 3000 + "."]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(draw.randrange(1, longest)):
            t = draw.choice([turn, turn, turn, turn + 1, None])
            rows.append((conv, t, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), draw.choice(texts) if draw.random() < 0.6 else f"text {turn}.", "x", "y"))
    return rows


@pytest.mark.parametrize("segment", [2, 256])
def test_repair_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = drawn_conversations(random.Random(segment), 60, 14)
    got = repair.repair_report(spark.createDataFrame(rows, CONVERSATIONS))
    want = brute_report([r[:4] for r in rows])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_repair_of_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 16)
    draw = random.Random(9)
    rows = [(7, t, draw.choice(["user", "assistant", "system"]), draw.choice(["a.", "b", f"c{t}.", f"d{t}"]), "x", "y") for t in range(3000)]
    got = repair.repair_report(spark.createDataFrame(rows, CONVERSATIONS).repartition(5))
    assert [tuple(r) for r in got.collect()] == brute_report([r[:4] for r in rows])


def test_repair_without_rows(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert repair.repair_report(empty).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = repair.repair_report(spark.createDataFrame([(dropped, 0, "user", "Hi.", "x", "y")], CONVERSATIONS)).collect()
    assert [tuple(r) for r in one] == [(dropped, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
