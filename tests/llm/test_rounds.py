"""Token files, spelling variants and dialogue repair against the library and brute force."""

import collections
import hashlib
import random
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from chronoweave.llm import catalogue, dialogue, library_tokens, rans, spelling, token_files
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


# token files


def test_pieces_are_the_librarys(library):
    rng = random.Random(3)
    some = [*"ab'stmdrevlSL  \n\n\t0129.,!é\xa0　 ß​中ǅ¼²\U0001f600\U00010400ᲊ\x1c\x85", "'s", "'re", " '", "'ll", "''", "<|endoftext|>"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 40))) for _ in range(5000)] + ["", "'", "'s", " ", "\n ", "a ", "x" * 5000, " " * 3000]
    want = [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    made = library_tokens.Encoder(library_tokens_path(), None)
    assert made.plain and made.encode(pa.array(texts)).to_pylist() == want
    made.plain = False
    assert made.encode(pa.array(texts[:200])).to_pylist() == want[:200]
    made = library_tokens.Encoder(library_tokens_path(), 7)
    assert made.encode(pa.array(["a", None, ""])).to_pylist() == [np.array([*library.encode("a").ids, 7], "<u2").tobytes(), b"\x07\0", b"\x07\0"]


def library_tokens_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_coder_round_trip(monkeypatch):
    rng = np.random.default_rng(5)
    for n, top in ((1, 1), (7, 3), (5000, 40), (70_000, 50_000)):
        ids = np.minimum((rng.pareto(0.7, n) * 2).astype(np.int64), top)
        table = rans.Table.of(collections.Counter(ids.tolist()))
        assert int(table.size.sum()) == 1 << table.bits and (rans.Table.unpack(table.pack()).size == table.size).all()
        lanes = rans.lanes_for(n)
        parts, got = rans.encode(ids, table), []
        for k, p in enumerate(parts):  # every part alone, from its own checkpoint
            got.append(rans.decode(p, min(lanes * rans.EVERY, n - k * lanes * rans.EVERY), lanes, table))
        assert (np.concatenate(got) == ids).all()
    assert len(parts) > 1
    bits = -sum(c / n * np.log2(c / n) for c in collections.Counter(ids.tolist()).values())
    assert sum(map(len, parts)) * 8 / n < 1.1 * bits + 0.5
    with pytest.raises(ValueError, match="share"):
        rans.encode(np.array([3]), rans.Table.of({1: 5, 4: 1}))


def stored(spark, rows, library, schema="doc_id long, text string"):
    folder = token_files.store(spark.createDataFrame(rows, schema).repartition(3))
    got = sorted(map(tuple, token_files.read(spark, folder, with_ids=True).collect()), key=lambda r: r[1])
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        data = struct.pack(f"<{len(ids)}I", *ids)
        want.append((r[0], at, len(ids), zlib.crc32(data), data))
        at += len(ids)
    return folder, got, want


def test_token_files(spark, library, monkeypatch):
    rng = random.Random(9)
    rows = [(i * 7 % 501, " ".join(rng.choices(["red", "Blue", "!", "green\n", "éä"], k=rng.randint(0, 60)))) for i in range(501)]
    rows += [(-5, None), (None, ""), (1000, "long " * 30_000)]
    folder, got, want = stored(spark, rows, library)
    assert [tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in got] == want
    # files hold whole documents in order; a changed byte is noticed
    files = spark.read.parquet(f"{folder}/manifest").collect()
    assert sum(f["n_docs"] for f in files) == len(rows) and sum(f["n_ids"] for f in files) == sum(w[2] for w in want)
    path = max(files, key=lambda f: f["n_ids"])["path"].removeprefix("file://")
    with open(path, "r+b") as file:
        file.seek(200)
        byte = file.read(1)
        file.seek(200)
        file.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="damaged"):
        token_files.read(spark, folder).collect()


def test_token_files_awkward(spark, library):
    # equal keys keep apart, an empty table makes nothing, columns beside do not matter
    folder, got, want = stored(spark, [(3, "b"), (3, "a"), (3, "a"), (1, "")], library)
    assert sorted(r[2:4] for r in got) == sorted(r[2:4] for r in want) and [r[1] for r in got] == [0, 1, 3, 5]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(spark, token_files.store(none)).count() == 0
    clash = spark.createDataFrame([(1, "a", 5, 6, 7)], "doc_id long, text string, key int, seq int, `a.b` int")
    assert [r["n_tokens"] for r in token_files.read(spark, token_files.store(clash)).collect()] == [2]


def test_many_parts(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 3000)
    monkeypatch.setattr(token_files, "FILE", 8000)
    monkeypatch.setattr(rans, "EVERY", 4)
    monkeypatch.setattr(rans, "LANES", 16)
    own = next(token_files._packed(pa.array([np.arange(5, dtype="<u2").tobytes()]), "<u2"))
    assert own.tolist() == [0, 1, 2, 3, 4]
    table = rans.Table.of({i: i + 1 for i in range(50)})
    folder = token_files._under(f"{token_files.shared_folder(spark)}/x")
    system, path = token_files._files(folder)
    system.create_dir(path)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50, n) for n in (1, 5, 2990, 10_000, 1, 7, 3000, 400)]
    out = token_files._Writer(folder, table, 1, 0)
    out.add(np.arange(8), np.zeros(8, bool), np.array([len(d) for d in docs]), np.concatenate(docs))
    name = out.close()[0]
    keys, nulls, lengths, parts, crc = token_files._footer(name)
    assert keys.tolist() == list(range(8)) and lengths.tolist() == [len(d) for d in docs] and crc == 1 and len(parts) > 10
    manifest = spark.createDataFrame([(name, 0, 8, int(lengths.sum()), 0)], token_files.MANIFEST)
    rows = [r.asDict(recursive=True) for r in token_files.parts_of(manifest).collect()]
    found = {}
    for r in rows:
        batch = token_files._documents(r, table, True).to_pylist()
        found |= {b["key"]: np.frombuffer(b["ids"], "<u4") for b in batch}
    assert all((found[i] == d).all() for i, d in enumerate(docs)) and len(rows) > 2


def test_op11(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in catalogue.op11_token_files(spark, SMALL).collect()}
    at = 0
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert len(got) == len(docs)


# spelling


def variants(counts, times=5):
    """word, form, root, n, n_near, form_n by deletions of one letter."""
    by, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by[w[:i], w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in counts:
                near[w].add(x), near[x].add(w)
    for same in by.values():
        for w in same:
            near[w] |= same - {w}
    form = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: f if f is not None and counts[f] >= times * counts[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def test_spelling_group(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices("abc", k=rng.randint(6, 8))) for _ in range(1500)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "ÿéÿéÿéÿ", "ÿéÿéÿé", "ÿéÿèÿéÿ"}
    # long words, an edit at the first letter, at the last, and in a long chain; roots over several steps
    words |= {"x" * 900, "x" * 901, "y" + "x" * 899, "x" * 450 + "z" + "x" * 449, "rootword", "rotword", "rtword", "rootwordy"}
    counts = {w: rng.choice([5, 6, 30, 200, 1100]) for w in sorted(words)} | {"rootword": 900, "rotword": 100, "rtword": 7, "rootwordy": 180}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    got = {tuple(r) for r in spelling.group(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == variants(counts)
    assert ("rtword", "rotword", "rootword", 7, 1, 100) in got


def test_spelling_awkward(spark):
    schema = "text string, n string, word string, `a.b` int"
    docs = spark.createDataFrame([("Schöner schöner SCHöner sch×ner", "", "", 1), (None, None, None, 2), ("", "x", "y", 3), ("schöner", "", "", 1)] * 2, schema)
    counted = {tuple(r) for r in spelling.count_words(docs).collect()}
    assert counted == {("schöner", 8)}  # Ö stays as it is; of four a text, three are in lower case
    assert spelling.count_words(docs, least=1).count() == 2
    assert [tuple(r) for r in spelling.group(spelling.count_words(docs)).collect()] == [("schöner", 8, 0, None, None, "schöner")]
    assert spelling.group(spelling.count_words(docs.limit(0))).count() == 0


def test_op12(spark):
    upper = str.maketrans(spelling.UPPER, spelling.LOWER)
    counts = collections.Counter()
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = w.translate(upper)
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    want = variants({w: n for w, n in counts.items() if n >= 5 and len(w) >= 6})
    assert {tuple(r) for r in catalogue.op12_spelling(spark, SMALL).collect()} == want


# dialogue


def repaired(rows):
    """The contract by recursion over (message, state), smallest (cost, audit) first."""
    out, by = {}, collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    for c, own in by.items():
        d = []
        for t, r, x in own:
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
            d += [(t, "user" if h == 4 else r, x)] * (0 if h == 0 else 2 if h == 3 else 1)
        d.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]))
        turns = [t for t, _, _ in d if t is not None]
        faults, seen = [], set()
        for _, r, x in d:
            said = x.strip(dialogue.WHITE)
            faults.append("b" if not said else "d" if (r, x) in seen else "" if said[-1] in ".!?" else "t")
            seen.add((r, x))
        initials = [r[:1] for _, r, _ in d]

        @lru_cache(None)
        def go(i, s, added):
            best = [(0, "", ())] if i == len(d) and s in "0a" else []

            def arc(price, letter, message, j, to, k=0):
                if rest := go(j, to, k):
                    best.append((price + rest[0], letter + rest[1], message + rest[2]))

            give, role = ("a", "assistant") if s == "u" else ("u", "user")
            if added < 2:
                arc(5, "I", ((role, ""),), i, give, added + 1)
            if i < len(d):
                _, r, x = d[i]
                arc(2, "D", (), i + 1, s)
                if faults[i] not in ("b", "d"):
                    more = 5 * (faults[i] == "t")
                    if (r[:1], s) in (("s", "0"), ("u", "0"), ("u", "s"), ("u", "a"), ("a", "u")):
                        arc(more, "K", ((r, x),), i + 1, r[:1])
                    arc(1 + more, "R", ((role, x),), i + 1, give)
            return min(best, default=None)

        for i in range(len(d), 0, -50):
            for s in "0sua":
                go(i, s, 0)
        cost, audit, messages = go(0, "0", 0)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        text = "\n".join(f"{r}:{x}" for r, x in messages)
        out[c] = (c, gaps, *[faults.count(f) for f in "bdt"], bad, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def write_conversations(spark, tmp_path, rows):
    folder = str(tmp_path / "t")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{folder}/conversations.parquet")
    return folder


def test_dialogue_hot(spark, tmp_path, monkeypatch):
    """Blocks of 4 messages and groups of 3 blocks: conversations over many blocks and several levels of groups."""
    monkeypatch.setattr(dialogue, "BLOCK_BITS", 2)
    monkeypatch.setattr(dialogue, "FAN", 3)
    rng = random.Random(1)
    roles, texts = ["user", "assistant", "system", "tool", None, ""], ["a.", "b", "c!", None, "", "d?", "e. \n", " "]
    sizes = [(None, 30), (1, 50), (2, 1), (3, 200), (4, 7), (5, 12)]
    rows = [(c, t if rng.random() > 0.1 else None, rng.choice(roles), rng.choice([*texts, f"f. {t}", f"g{t}."])) for c, n in sizes for t in range(n)]
    rows = list(dict.fromkeys(rows))
    rng.shuffle(rows)
    got = {r[0]: tuple(r) for r in catalogue.op13_dialogue(spark, write_conversations(spark, tmp_path, rows)).collect()}
    assert got == repaired(rows)


def test_dialogue_awkward(spark, tmp_path):
    # (0, 20) and others with remainder 0 are dropped: find turns that are, for a conversation without rows
    gone = [(9, t, "user", "a.") for t in range(400) if zlib.crc32(f"9:{t}".encode()) % 20 == 0]
    rows = [*gone, (1, 1, "user", "a."), (1, 1, "user", "a."), (2, None, None, None)]
    got = {r[0]: tuple(r) for r in catalogue.op13_dialogue(spark, write_conversations(spark, tmp_path, rows)).collect()}
    assert got == repaired(rows) and got[9] == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    summary, messages = dialogue.repair(empty)
    assert summary.count() == 0 and messages.count() == 0 and dialogue.digest(messages).count() == 0


def test_dialogue_messages(spark):
    rows = [("x", 0, "system", "be kind."), ("x", 1, "assistant", "hello."), ("x", 2, "assistant", "hello."), ("x", 3, "user", " "), ("y", 0, "tool", "q?")]
    df = spark.createDataFrame(rows, "id string, at int, who string, said string")
    summary, messages = dialogue.repair(df, "id", "at", "who", "said")
    assert {r["talk"]: (r["audit"], r["cost"]) for r in summary.collect()} == {"=x": ("RKDD", 5), "=y": ("D", 2)}
    assert [(r["role"], r["text"]) for r in messages.orderBy("place").collect()] == [("user", "be kind."), ("assistant", "hello.")]
    df = spark.createDataFrame([("x", 0, "system", "s."), ("x", 1, "user", "a?"), ("x", 2, "user", "b."), ("x", 3, "user", "c.")], "id string, at int, who string, said string")
    summary, messages = dialogue.repair(df, "id", "at", "who", "said")
    assert [r["audit"] for r in summary.collect()] == ["KDKR"]
    assert [(r["role"], r["text"]) for r in messages.orderBy("place").collect()] == [("system", "s."), ("user", "b."), ("assistant", "c.")]


def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r) for r in catalogue.op13_dialogue(spark, SMALL).collect()}
    assert got == repaired(rows)


def test_ranks_choose_the_least(spark):
    """Every node's audit by doubled pointers is the least of all cheapest ones."""
    rng = random.Random(8)
    codes = [np.array([rng.randrange(12) for _ in range(rng.randint(0, 6))]) for _ in range(40)]
    nodes = dialogue.Nodes(codes, np.tile(dialogue.FINAL, (40, 1)), np.ones(40, bool))
    for first in range(4):
        block, letter, _ = nodes.paths(np.full(40, first))
        for b, own in enumerate(codes):
            best = {(len(own), s): (0, "") for s in (0, 3)}
            for _ in range(3 * len(own) + 6):  # relax until nothing changes
                for i in range(len(own), -1, -1):
                    for s in range(4):
                        found = [best[i, s]] if (i, s) in best else []
                        for k, (can, price, to) in enumerate(nodes.arcs):
                            v = nodes.base[b] + 4 * i + s
                            if can[v]:
                                j = (int(to[v]) - nodes.base[b]) // 4, int(to[v]) % 4
                                if j in best and len(best[j][1]) < 30:
                                    found.append((int(price[v]) + best[j][0], dialogue.LETTERS[k] + best[j][1]))
                        if found:
                            best[i, s] = min(found)
            assert "".join(dialogue.LETTERS[x - 1] for x in letter[block == b]) == best[0, first][1]
            assert nodes.cost[nodes.base[b] + first] == best[0, first][0]
