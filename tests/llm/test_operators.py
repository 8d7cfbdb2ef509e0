"""The corpus operators against plain versions, on rows with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quire.llm import audio, chat, decontam, lm, minhash, mixing, quality, tokens, toxicity
from quire.llm.lines import dedup_lines
from quire.llm.common import Stages
from quire.llm.minhash import components, near_duplicates

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = [], DOCS


def rows_of(texts):
    return [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]


def odd_texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "Éa", "ñu", "THE", "x1", "don't", "a.b", "größe", "и", "日本", "end."]
    out = [None, "", " ", "\n\n", "one", "One two", "\x0bone\x0ctwo\rthree", "a" * 5000, "the " * 3000, "<|endoftext|> <|ENDOFTEXT|>", "é  x  y"]
    out += [" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    base = out[20] + " " + out[21] + " " + out[22]
    out += [base, base, base + " tail", base.upper(), base.replace("the", "thy", 1)]
    return out


def shingles(text, size):
    w = SPACED.findall((text or "").translate(LOW))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def plain_components(texts, size):
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {k: (len(sets[k]), find(k), find(k) == k) for k in range(len(texts))}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rng = random.Random(size)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = odd_texts()
    for k in range(60):  # a group of near copies, some of them too far off
        own = list(base)
        for _ in range(rng.randrange(0, 14)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows_of(texts), DOCS), shingle=size).collect()}
    assert got == plain_components(texts, size)


def test_near_duplicates_of_no_rows_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame(*EMPTY)).count() == 0
    df = spark.createDataFrame([(None, "a b c", 1), (None, None, 2), (3, "a b c", 3), (3, "a b c", 3)], "doc_id long, text string, sig long")
    got = [tuple(r) for r in near_duplicates(df, shingle=2).collect()]
    assert sorted(got, key=repr) == sorted([(None, 2, None, True), (None, 0, None, True), (3, 2, 3, True), (3, 2, 3, True)], key=repr)


def test_near_duplicates_of_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (3, a), (7, b), (7, c), (9, c + " more"), (1, None), (5, a), (11, " ".join(f"d{k}" for k in range(30)))]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect())
    assert got == sorted([(5, 29, 3, False), (5, 29, 3, False), (5, 29, 3, False), (3, 29, 3, True), (7, 29, 3, False), (7, 29, 3, False), (9, 30, 3, False), (1, 0, 1, True), (11, 29, 11, True)])


def test_components_of_a_long_chain(spark):
    stages = Stages(spark, "test")
    got = {r.id: r.component for r in components(stages, spark.range(1, 1000).selectExpr("id AS b", "id - 1 AS a")).collect()}
    assert got == {k: 0 for k in range(1000)}
    assert sum("roots" in p for p in stages.paths) <= 12
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    root = {}
    for x, y in links:
        group = root.get(x, {x}) | root.get(y, {y})
        for k in group:
            root[k] = group
    df = spark.createDataFrame([(min(x), max(x)) for x in links], "a long, b long")
    assert {r.id: r.component for r in components(Stages(spark, "test"), df).collect()} == {k: min(g) for k, g in root.items()}


def test_near_duplicates_of_one_template(spark, monkeypatch):
    """Hundreds of texts that share most of their shingles, but not enough, meet few others."""
    rows = {}

    class Counted(Stages):
        def put(self, df, name):
            out = super().put(df, name)
            rows[name] = out.count()
            return out

    monkeypatch.setattr(minhash, "Stages", Counted)
    rng = random.Random(12)
    base = [f"t{k}" for k in range(80)]
    texts = [" ".join([*base, *(f"own{k}-{j}" for j in range(30))]) for k in range(400)]
    texts += [t + " tail" for t in texts[:20]]  # and some real copies
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows_of(texts), DOCS), shingle=2).collect()}
    assert got == plain_components(texts, 2)
    assert rows["rest"] > 400 and rows["meets"] <= 2 * len(texts)


def plain_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 40:
                held[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < 40 or len(held[key(x)]) < 5 or max(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(spark):
    common, wide = "A line that many documents share, word for word.", "é" * 40
    rows = [(k, f"own {k}\n  {common.upper() if k % 2 else common}\t\nshort\n{common}") for k in range(6)] + [(10 + k, f"{wide}\n{wide[:39]}") for k in range(5)]
    rows += [(None, common), (20, None), (21, ""), (22, "\n"), (5, common), (30, common + "\n\n"), (31, "x\r\n" + common + "\r")]
    df = spark.createDataFrame([(d, t, 1, "h") for d, t in rows], "doc_id long, text string, h long, lines string")
    assert sorted((tuple(r) for r in dedup_lines(df).collect()), key=repr) == plain_lines(rows)
    assert dedup_lines(spark.createDataFrame(*EMPTY)).count() == 0


def test_lines_of_a_long_text(spark):
    """As many lines go as there are, with work that is linear in them."""
    shared = [f"a shared line of at least forty characters, number {k % 1000}" for k in range(200_000)]
    own = [f"line {k}" for k in range(len(shared))]
    long = "\n".join(x for pair in zip(shared, own) for x in pair)
    rows = [(k, "\n".join(shared[:1000])) for k in range(10, 15)] + [(1, long), (1, "one id, another text\n" + shared[0]), (1, long)]
    got = sorted((tuple(r) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 1").collect()), key=lambda r: r[1])
    assert got == [(1, 2, 1, "one id, another text")] + 2 * [(1, 400_000, 200_000, "\n".join(own))]


def plain_hits(docs, items, n=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                own = windows.get(tuple(w[k : k + size]))
                if own:
                    hit.update(range(k, k + size))
                    found |= own
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_contamination(spark, monkeypatch):
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(12)] + ["the", "of"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 9, 10, 14, 30])))) for k in range(12)] + [(100, None), (None, "the of the of"), (7, "repeated item"), (101, ",;"), (5, items_text := "Exact Words, of-a passage: that stands; in the text twice today")]
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(200)))) for k in range(40)] + [(50, None), (51, ""), (52, "x " + items_text.upper() + " y " + items_text), (53, items[3][1] + " " + items[4][1]), (54, "v1 " * 5000), (55, "v1 v1 xx " * 50)]
    df = spark.createDataFrame([(d, t, "row", "spans") for d, t in docs], "doc_id long, text string, row string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(docs, items)
    assert {r[0]: tuple(r[1:]) for r in decontam.report(df, bench).collect()} == want
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 120)  # several blocks of items
    assert {r[0]: tuple(r[1:]) for r in decontam.report(df, bench).collect()} == want
    cut = {r[0]["doc_id"]: r[1] for r in decontam.contamination(df, bench, cut=True).select("row", "text").collect()}
    assert cut[50] is None and cut[51] == "" and "passage" not in cut[52].lower()
    for d, t in cut.items():
        assert len(ALNUM.findall((t or "").translate(LOW))) == want[d][0] - want[d][1]
    assert decontam.report(spark.createDataFrame(*EMPTY), bench).count() == 0
    assert not any(r.contaminated for r in decontam.report(df, spark.createDataFrame([], "item_id long, text string")).collect())


def test_cuts_that_join_a_window(spark):
    """What a cut leaves is searched again."""
    item = "one two three four five six seven eight nine ten"
    half = item.split()
    nested = " ".join([*half[:5], *half, *half[5:]])
    twice = " ".join([*half[:3], *nested.split(), *half[3:]])
    df = spark.createDataFrame([(1, f"a {nested} b", "x"), (2, f"{twice}", "y"), (3, "clean text", "z"), (4, None, None), (4, item, None)], "doc_id long, text string, row string")
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    out = decontam.decontaminate(df, bench).select("row.doc_id", "row.row", "text", "n_words").collect()
    assert sorted((r[0], r[1], " ".join((r[2] or "-").split())) for r in out if r[2] != "") == [(1, "x", "a b"), (3, "z", "clean text"), (4, None, "-")]
    assert sorted(r[0] for r in out if r[2] is not None and not r[2].strip()) == [2, 4]
    assert decontam.decontaminate(spark.createDataFrame(*EMPTY), bench).count() == 0


def test_index_search_and_locate():
    rng = np.random.default_rng(5)
    for n, top in ((1, 3), (50, 3), (400, 6)):
        text = rng.integers(1, top + 1, n)
        index = decontam.FMIndex(text, top)
        for length in (1, 3):
            patterns = rng.integers(1, top + 1, (20, length))
            lo, hi = index.search(patterns)
            for p, a, b in zip(patterns, lo, hi):
                want = [k for k in range(n - length + 1) if (text[k : k + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b))) == want


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
@pytest.mark.parametrize("top", [1, 2, 50_000, 2**32 - 1])
def test_blocks_of_ids(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[:: 17 if n > 17 else 1] = min(top, 2**32 - 1)
    assert (tokens.decode_ids(tokens.encode_ids(ids)) == ids).all()


TOKENIZERS = pytest.importorskip("public_tokenizers")


def test_tokens(spark):
    from tokenizers import Tokenizer

    path = str(TOKENIZERS.path("word_bpe_49k.json"))
    texts = odd_texts() + ["it's 'tis we'd x'S 3.14, 1,000!! (a) [b] end.", "ABC.DEF, ghi... ,x .y", "naïve café Übung ×÷ µ", "a<|endoftext|>b. C<|startoftext|>,"]
    rows = [(900 - k, t) for k, t in enumerate(texts)] + [(None, "null id"), (900, "a repeated id")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, part long")
    got = sorted((tuple(r) for r in tokens.read_tokens(tokens.write_tokens(df, path)).collect()), key=lambda r: r[1])
    plain, want, start = Tokenizer.from_file(path), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert tokens.read_tokens(tokens.write_tokens(spark.createDataFrame(*EMPTY), path)).count() == 0


MARKED = ["5€. “a”, … ! हैं. 😀!", "word”. …! », 10°, —, 日本。. ×.", "é. ß, Ü! ÿ? é. e\u0301. ñ.. É€. ÷: a×. Ã. ª. ²; ³. ч. 日. ४. 'é'. a's. 7. €. .", "É. ×", "é", ".", "×.", "é."]


def test_marks_after_other_marks():
    """A mark at a word's end is one piece with a sign or combining character before it, however words are kept."""
    from tokenizers import Tokenizer

    path = str(TOKENIZERS.path("word_bpe_49k.json"))
    raw = [x.encode() for x in MARKED]
    plain, coder = Tokenizer.from_file(path), tokens.encoder(path)
    assert isinstance(coder, tokens.WordEncoder)
    for _ in range(2):  # the second time all words are known
        ids, n = coder.encode(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in MARKED]


def same_ids(plain, coder, texts):
    raw = [x.encode() for x in texts]
    ids, n = coder.encode(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.ids for x in plain.encode_batch_fast(texts, add_special_tokens=False)]


def test_tokens_of_any_text():
    """30,000 texts of letters, marks, signs, combining characters and blanks of many scripts."""
    from tokenizers import Tokenizer

    path = str(TOKENIZERS.path("word_bpe_49k.json"))
    plain, coder = Tokenizer.from_file(path), tokens.encoder(path)
    texts = ["He said \u201chello\u201d.", "\u201cReally\u201d, she said", "wait\u2026?", "costs 5\u20ac.", "\u00aboui\u00bb,", "30\u00b0.", "a\u2013, b", "\u0939\u093f\u0928\u094d\u0926\u0940."]
    rng = random.Random(11)
    ranges = [(0x20, 0x7F)] * 6 + [(0x80, 0x250), (0x2B0, 0x370), (0x370, 0x530), (0x900, 0x980), (0x2000, 0x2100), (0x20A0, 0x20D0), (0x2190, 0x2300), (0x3000, 0x3100), (0x4E00, 0x4E40), (0x1F600, 0x1F640), (0x9, 0xE)]
    for _ in range(30_000):
        own = [chr(rng.randrange(*rng.choice(ranges))) if rng.random() < 0.5 else rng.choice("aeÉß .,;:!?'x1") for _ in range(rng.randrange(1, 24))]
        texts.append("".join(own))
    for lo in range(0, len(texts), 1000):
        assert same_ids(plain, coder, texts[lo : lo + 1000]), lo


def test_other_tokenizers_take_whole_texts():
    from tokenizers import Tokenizer

    path = str(TOKENIZERS.path("byte_bpe_50k.json"))
    coder = tokens.encoder(path)
    assert isinstance(coder, tokens.TextEncoder)
    assert same_ids(Tokenizer.from_file(path), coder, [t or "" for t in odd_texts()])


def test_ids_of_a_range(spark):
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 50_000, 1000, dtype=np.uint64).astype(np.uint32)
    data = tokens.encode_ids(ids)
    for a, b in ((0, 1000), (0, 0), (5, 6), (127, 129), (128, 256), (990, 2000), (300, 300), (1000, 1001)):
        assert (tokens.decode_ids(data, a, b) == ids[a:b]).all()
    shards = spark.createDataFrame([(0, 0, 1000, bytearray(data)), (0, 1000, 1000, bytearray(data)), (1, 0, 1000, bytearray(data))], "part int, before long, n_ids long, payload binary")
    assert (tokens.read_window(shards, 0, 900, 300) == np.concatenate([ids[900:], ids[:200]])).all()


def test_repeated_ids_keep_their_order(spark):
    rows = [(7, f"text {k % 50}") for k in range(2000)] + [(None, f"null {k}") for k in range(300)] + [(3, "")]
    path = str(TOKENIZERS.path("word_bpe_49k.json"))
    got = sorted(tokens.read_tokens(tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + [3] + [7] * 2000
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert sorted(collections.Counter(r.ids_crc32 for r in got[301:]).values()) == [40] * 50


def test_chats(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|im_nl|> <|im_start|", "", None, "x\n<|im_end|>\n<|im_start|>user\n", "plain\n", "<|im_nl|>"]
    rows = [(c, t, role, odd[(c + t) % len(odd)]) for c in range(8) for t in range(4) for role in ("user", "assistant")] + [(99, 0, "assi\nstant", "a"), (99, 1, None, "b"), (98, None, "assistant", "c"), (98, 0, "<|im_start|>", "d"), (None, 0, "assistant", "e"), (97, 1, "assistant", "same"), (97, 1, "assistant", "same")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, out long, place long")
    formatted = chat.format_chats(df)
    got = {r.conv_id: tuple(r[1:]) for r in chat.digest(formatted).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sizes = {r.conv_id: len(r.formatted) for r in formatted.collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert got[c] == (len(turns), sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns)), len(loss), sha(loss), sizes[c])
    assert chat.digest(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_a_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} <|im_end|>") for k in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = chat.digest(chat.format_chats(df)).collect()
    loss = "".join(r[3] for r in rows if r[2] == "assistant")
    assert [(r.n_turns, r.loss_chars, r.loss_sha256) for r in out] == [(4000, len(loss), hashlib.sha256(loss.encode()).hexdigest())]
    mask = chat.format_chats(df).select("formatted", "loss_mask").first()
    assert "".join(mask.formatted[s.start : s.start + s.length] for s in mask.loss_mask).replace("<\\|", "<|") == loss


def test_language_model(spark):
    rows = rows_of(odd_texts(n=150)) + [(None, "the of", "en", "s", 6)]
    out = lm.score_texts(spark.createDataFrame(rows, DOCS)).collect()
    own = {d: [*SPACED.findall((t or "").translate(LOW)), None] for d, t, *_ in rows}
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = collections.Counter(x for d, w in own.items() if not fold(d) for x in w)
    n, v = sum(counts.values()), len(counts)
    assert len(out) == len(rows)
    for r in out:
        w = own[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id), len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0 and math.isfinite(r.score)
    assert lm.score_texts(spark.createDataFrame(*EMPTY)).count() == 0


def small_model(n_words=3000, seed=0):
    """A model with random weights over words w0, w1, ... by falling counts, and four texts of them and other words."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(n_words)]
    raw = " ".join(words).encode()
    with np.errstate(over="ignore"):
        h = lm.Words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8)).hash
    n_leaf, v_leaf = rng.integers(0, 50, lm.LEAVES).astype(float), rng.integers(0, 9, lm.LEAVES).astype(float)
    vocab = lm.Vocabulary.build(np.append(h, lm.END), np.append(2 * n_words - np.arange(n_words), 4 * n_words), n_leaf, v_leaf)
    model = lm.MaxEnt(vocab)
    for w in (model.class_w, model.node_w):
        w += rng.normal(size=w.shape).astype(np.float32) / 3
    texts = [" ".join(rng.choice([*words, "other", "unknown", "Wörter"]) for _ in range(n)) for n in (0, 1, 40, 300)]
    raw = [t.encode() for t in texts]
    return model, lm.Tokens(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8), vocab), texts, dict(zip([*words, None], vocab.rank[np.searchsorted(vocab.hash, np.append(h, lm.END))].tolist()))


def plain_path(rank):
    """Class, nodes and branches of a frequent word, by counting through the classes."""
    for k, size in enumerate(lm.SIZES.tolist()):
        if rank < size:
            break
        rank -= size
    digits = []
    while size > 1:
        size //= lm.BRANCH
        digits.append(rank // size)
        rank %= size
    nodes = [k, lm.SECOND + k * lm.BRANCH + digits[0], lm.THIRD + ((k - 16) * lm.BRANCH + digits[0]) * lm.BRANCH + (digits[1] if len(digits) > 1 else 0)]
    return k, nodes[: len(digits)], digits


def test_score_of_one_token_at_a_time():
    model, t, texts, rank = small_model()
    v, got, at = model.vocab, model.score(t), 0
    pick = lambda z, k: z[k] - math.log(sum(math.exp(x) for x in z))
    for text in texts:
        history = [lm.START, lm.START]
        for word in [*text.lower().split(), None]:
            prev, skip = history[-1], history[-2]
            if word in rank:
                k, nodes, branches = plain_path(rank[word])
            else:
                raw = word.encode()
                r = (raw[-1] * 5 + (raw[-2] if len(raw) > 1 else 0) * 13) % lm.RARE
                low = int(t.hash[at]) % lm.BRANCH**2
                k, branches = lm.CLASSES + r, [low // lm.BRANCH, low % lm.BRANCH]
                nodes = [k, lm.SECOND + k * lm.BRANCH + branches[0]]
                assert t.leaf[at] == r * lm.BRANCH**2 + low
            z = v.class_log.astype(float) + model.class_w[prev] + model.class_w[lm.HISTORY + skip] + model.class_w[2 * lm.HISTORY + (prev * 4099 + skip * 7919) % lm.PAIRS]
            want = pick(z, k)
            for node, b in zip(nodes, branches):
                z = v.node_log[node].astype(float) + model.node_w[(node * 1361 + prev * 2654435761) % lm.INNER] + model.node_w[lm.INNER + (node * 1847 + skip * 2246822519) % lm.INNER]
                want += pick(z, b)
            assert got[at] == pytest.approx(want, abs=1e-4)
            with np.errstate(over="ignore"):
                hashed = lm.OWN + int(lm.mix(t.hash[at : at + 1])[0] % np.uint64(lm.HASHED))
            history.append(rank[word] if rank.get(word, lm.OWN) < lm.OWN else hashed)
            at += 1
    assert at == len(got)


def test_probabilities_add_up():
    """Over all frequent words and all leaves of other words, for one history."""
    model, t, _, rank = small_model()
    prev, skip = t.prev[50], t.skip[50]
    rows = tuple(np.array([x]) for x in (prev, lm.HISTORY + skip, 2 * lm.HISTORY + (prev * 4099 + skip * 7919) % lm.PAIRS))
    shares = lambda z: np.exp(z[0]) / np.exp(z[0]).sum()
    classes, total = shares(model.classes(rows)), 0.0
    branch = lambda node: shares(model.nodes((np.array([(node * 1361 + prev * 2654435761) % lm.INNER]), np.array([lm.INNER + (node * 1847 + skip * 2246822519) % lm.INNER])), np.array([node])))
    known = {}
    for r in rank.values():
        k, nodes, branches = plain_path(r)
        p = classes[k]
        for node, b in zip(nodes, branches):
            if node not in known:
                known[node] = branch(node)
            p *= known[node][b]
        total += p
    for k in range(lm.CLASSES, lm.CLASSES + lm.RARE):
        one = branch(k)
        total += classes[k] * sum(one[b] * branch(lm.SECOND + k * lm.BRANCH + b).sum() for b in range(lm.BRANCH))
    assert total == pytest.approx(1, abs=1e-3)  # places that no word has keep a little


def test_gradient_of_the_weights():
    model, t, _, _ = small_model()
    sums = lm.Gradient()
    sums.add(model, t)
    rng = np.random.default_rng(1)
    for w, g in ((model.class_w, sums.class_g.T), (model.node_w, (sums.node_g + sums.node_e).T)):
        for at in np.argwhere(np.abs(g) > 0.5)[rng.integers(0, (np.abs(g) > 0.5).sum(), 8)]:
            at = tuple(at)
            keep, ends = w[at], []
            for d in (0.05, -0.05):
                w[at] = keep + d
                ends.append(model.score(t).sum())
            w[at] = keep
            assert g[at] == pytest.approx(-(ends[0] - ends[1]) / 0.1, rel=0.02, abs=0.02)


def test_scores_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r for r in lm.score_texts(docs.repartition(n)).collect()} for n in (2, 24))
    assert one.keys() == many.keys()
    for d, r in one.items():
        assert many[d].score == pytest.approx(r.score, rel=1e-6) and many[d].base_score == pytest.approx(r.base_score, rel=1e-9)
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and np.mean([r.score > r.base_score for r in held]) > 0.8


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    rows, labels = [], []
    for k in range(500):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 300))).capitalize() + "."
        kind = k % 4
        if kind == 1:
            text = " ".join(x.upper() + "!!" for x in text.split())
        if kind == 2:
            spot = text.split()
            for _ in range(3):
                spot.insert(rng.randrange(len(spot)), rng.choice(["zornig", "zornigen", "quaxer"]))
            text = " ".join(spot)
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, int(kind != 1), int(kind == 2)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "zorniger und quaxxer Text", "en", "s", 9), (1003, "word " * 30_000, "en", "s", 9)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (2000, None, None)], "doc_id long, quality int, toxic int")


def fold4(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


def test_quality(spark, labelled):
    docs, labels = labelled
    model = quality.train_quality(docs, labels)
    got = {r.row.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.dropna().collect()}
    held = [d for d in truth if d in got and fold4(d)]
    assert sum((got[d] >= 0.5) == truth[d] for d in held) >= 0.97 * len(held)
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    none = quality.train_quality(docs, labels.where("quality = 1"))
    assert none is None and {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    clash = docs.withColumn("row", docs.doc_id).withColumn("score", docs.doc_id)
    assert quality.score_quality(clash, model).count() == docs.count()
    assert quality.score_quality(spark.createDataFrame(*EMPTY), model).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, quality.N_FEATURES))
    first, y = np.array([0, 3, 4, 12]), np.array([1.0, 0.0, 1.0])
    model = quality.AttentionModel.start(x)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    loss = lambda: -np.mean(np.log(np.where(y == 1, s := model.score(x, first), 1 - s)))  # noqa: E731, F841
    g = model.gradient(x, first, y)
    for k, v in model.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        v[at] += 1e-6
        up = loss()
        v[at] -= 2e-6
        down = loss()
        v[at] += 1e-6
        assert g[k][at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7)


def test_toxicity(spark, labelled):
    docs, labels = labelled
    model = toxicity.train_toxicity(docs, labels)
    got = {r.row.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.dropna().collect()}
    held = [d for d in truth if d in got and fold4(d)]
    assert sum((got[d] >= 0.3) == truth[d] for d in held) >= 0.97 * len(held)
    assert got[1002] > 0.3 > got[1003] and got[1000] == got[1001] < 0.3
    assert toxicity.score_toxicity(spark.createDataFrame(*EMPTY), None).count() == 0


def test_mixing(spark, labelled):
    docs, labels = labelled
    got = mixing.mix(docs, mixing.label_domains(labels), {"clean": 0.8, "toxic": 0.15, "junk": 0.05}).collect()
    total = sum(r.n_tokens for r in got)
    p = np.array([r.posterior for r in got])
    n, rate = np.array([r.n_tokens for r in got]), np.array([r.rate for r in got])
    mass = dict(zip(["clean", "junk", "toxic"], (n * rate) @ p / total))
    assert mass == pytest.approx({"clean": 0.8, "toxic": 0.15, "junk": 0.05}, abs=2e-3)
    assert (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got) and len(got) == docs.count()
    truth = {r.doc_id: r.domain for r in mixing.label_domains(labels).dropna().collect()}
    order = ["clean", "junk", "toxic"]
    assert np.mean([order[int(np.argmax(r.posterior))] == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.95
    assert mixing.mix(spark.createDataFrame(*EMPTY), mixing.label_domains(labels), {"clean": 1.0}).count() == 0


def plain_scores(texts, model):
    """The attention model for one text at a time, in plain loops over passages."""
    out = []
    for t in texts:
        raw = (t or "").encode()
        x, _ = quality.passages(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
        p, hs, logits = model.p, [], []
        for row in np.clip((x - model.centre) / model.scale, -6, 6):
            h = np.tanh(row @ p["W"] + p["c"])
            hs.append(h)
            logits.append(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["G"])))) @ p["u"]))
        a = np.exp(np.array(logits) - max(logits))
        z = sum(w * h for w, h in zip(a / a.sum(), hs))
        out.append(1 / (1 + math.exp(-float(z @ p["o"] + p["b"][0]))))
    return out


def test_quality_of_one_text_at_a_time(spark, labelled):
    docs, labels = labelled
    model = quality.train_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert [r.score for r in rows] == pytest.approx(plain_scores([r.row.text for r in rows], model), abs=1e-5)


def test_passages_by_hand():
    text = "One, two. two\n" + "x " * 63 + "END!"
    raw = text.encode()
    x, first = quality.passages(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
    assert first.tolist() == [0, 2] and len(x) == 2
    words = text.split()
    for row, at in zip(x, (0, 64)):
        own = words[at : at + 64]
        assert row[8] == pytest.approx(math.log1p(sum(map(len, own)) / len(own)), rel=1e-5)
        low = [w.lower() for w in own]
        before = [*(w.lower() for w in words[max(0, at - 1) : at]), *low]
        assert row[10] == pytest.approx(sum(a == b for a, b in zip(before, before[1:])) / len(own), rel=1e-5)
        assert row[12] == pytest.approx(len(set(low)) / len(own), rel=1e-5)
        assert row[16] == pytest.approx(sum(w.endswith(".") for w in own) / len(own), rel=1e-5)


def test_toxicity_of_one_text_at_a_time(spark, labelled):
    """The worst mean over three words, window by window."""
    docs, labels = labelled
    model = toxicity.train_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs.where("doc_id < 40 OR doc_id >= 1000"), model).collect()
    for r in rows:
        raw = (r.row.text or "").encode()
        with np.errstate(over="ignore"):
            w = toxicity.Words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
            bags = [toxicity.subwords(w, np.array([k]))[0] for k in range(min(600, len(w.hash)))]  # the long text repeats one word
        means = [model.table[np.concatenate(bags[k : k + 3])].mean(axis=0) for k in range(max(1, len(bags) - 2))] if bags else [np.zeros(toxicity.DIM)]
        assert r.score == pytest.approx(max(float(model.softmax(m[None])[0, 1]) for m in means), abs=1e-4)


def test_subwords_leave_all_marks_off():
    raw = b"((((((((word!!!!!!!!!! word !!!!! \"w\""
    with np.errstate(over="ignore"):
        w = toxicity.Words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
        rows = [toxicity.subwords(w, np.array([k]))[0].tolist() for k in range(4)]
    assert rows[0] == rows[1] and len(rows[2]) == len(range(3, 6)) + sum(max(0, 7 - n + 1) - 1 for n in (3, 4, 5)) + 1 and rows[3] != rows[2]


def test_rates_against_a_plain_solver(spark):
    """Nonnegative least squares by many small projected gradient steps on one machine."""
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    n = rng.integers(0, 200, 300)
    soft = spark.createDataFrame([(int(a), [float(y) for y in b]) for a, b in zip(n, p)], "n_tokens long, posterior array<double>").repartition(3)
    for weights, budget in (([0.5, 0.3, 0.2], 1.0), ([0.9, 0.05, 0.05], 2.0), ([1.0, 0.0, 0.0], 1.0)):
        fit = mixing.fit_rates(soft, np.array(weights), budget)
        rate = mixing.rates(p, fit.moves)
        assert (rate >= 0).all() and fit.reached == pytest.approx((n * rate) @ p, rel=1e-9)
        goal = np.array(weights) * n.sum() * budget
        assert fit.residual == pytest.approx(np.abs(fit.reached - goal).max() / goal.sum(), abs=1e-12)
        r = np.ones(300)
        for _ in range(20_000):
            r = np.maximum(0, r - 0.5 * p @ (((n * r) @ p - goal) / n.sum()))
        best = np.abs((n * r) @ p - goal).max() / goal.sum()
        assert fit.residual <= best + 0.01  # the last goal is out of reach, and a fit ends where steps bring little more


def plain_mel(payload):
    """Log-mel values frame by frame with a direct Fourier sum."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    y = audio.resample(x.astype(np.float32)).astype(float)
    n = max(1, math.ceil((len(y) - audio.FRAME) / audio.HOP) + 1)
    y = np.concatenate([y, np.zeros(n * audio.HOP + audio.FRAME)])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / (audio.FRAME - 1))
    wave = np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME // 2 + 1), np.arange(audio.FRAME)) / audio.FRAME)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [hz(mel(20.0) + k * (mel(audio.OUT_RATE / 2) - mel(20.0)) / (audio.MELS + 1)) for k in range(audio.MELS + 2)]
    out = []
    for k in range(n):
        power = np.abs(wave @ (y[k * audio.HOP : k * audio.HOP + audio.FRAME] * window)) ** 2
        row = []
        for lo, mid, hi in zip(edges, edges[1:], edges[2:]):
            total = 0.0
            for b, v in enumerate(power):
                f = b * audio.OUT_RATE / audio.FRAME
                total += v * max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid)))
            row.append(max(float(audio.FLOOR), math.log(max(total, 1e-30))))
        out.append(row)
    return np.array(out)


def test_log_mel_by_a_direct_sum():
    rng = np.random.default_rng(3)
    for size in (64, 640, 4096):
        payload = bytes(rng.integers(0, 256, size, dtype=np.uint8))
        x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
        got, energy = audio.log_mel(audio.resample(x))
        want = plain_mel(payload)
        assert got.shape == want.shape and np.abs(got - want).max() < 0.02


def plain_segments(energy):
    middle, out, open_at, strong = float(np.median(energy)), [], None, False
    for k, e in enumerate([*energy, -np.inf]):
        if e > middle + audio.CLOSE_DB:
            open_at = k if open_at is None else open_at
            strong |= e > middle + audio.OPEN_DB
        elif open_at is not None:
            if strong:
                out.append([open_at, k])
            open_at, strong = None, False
    return out


def test_segments_by_a_plain_loop():
    rng = np.random.default_rng(6)
    for _ in range(200):
        energy = rng.normal(size=rng.integers(1, 60)) * rng.choice([0.3, 2.0])
        assert audio.segments(energy).tolist() == plain_segments(energy)


def test_clips_are_read_back_from_a_table(spark):
    clips = audio.store(audio.audio_columns(spark.createDataFrame(rows_of(odd_texts()), DOCS)))
    assert clips.inputFiles() and audio.digest(clips).count() == len(odd_texts())


def test_audio(spark):
    rows = rows_of(odd_texts())
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", media int")
    clips = audio.audio_columns(df)
    got = {r.doc_id: r for r in audio.digest(clips).collect()}
    by_text = collections.defaultdict(set)
    for d, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        wav = audio.write_wav(payload)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        by_text[raw].add(r.feature)
    assert all(len(x) == 1 for x in by_text.values())
    assert audio.digest(audio.audio_columns(spark.createDataFrame(*EMPTY))).count() == 0


def test_resampling_keeps_a_tone_and_segments_find_a_burst():
    t = np.arange(16_000) / audio.RATE
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(y) == audio.OUT_RATE
    spectrum = np.abs(np.fft.rfft(y))
    assert int(np.argmax(spectrum)) == 440 and 0.9 < np.abs(y[2000:8000]).max() < 1.1
    high = audio.resample(np.sin(2 * np.pi * 7000 * t).astype(np.float32))
    assert np.abs(high[2000:8000]).max() < 0.2  # above half the new rate
    energy = np.array([0, 0, 1, 1, 9, 9, 1, 0, 1, 0, 0, 0, 0, 0.0])
    assert audio.segments(energy).tolist() == [[2, 7]]


def test_audio_values_of_a_naive_resampler():
    rng = np.random.default_rng(1)
    x = rng.normal(size=200).astype(np.float32)
    h = audio.phases()
    taps = np.zeros(h.size)
    for p in range(audio.UP):
        taps[p :: audio.UP] = h[p]
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    lead = 8 * max(audio.UP, audio.DOWN) // audio.UP * audio.UP
    full = np.concatenate([np.convolve(up, taps), np.zeros(200)])
    want = full[lead : lead + len(up)][:: audio.DOWN]
    assert np.allclose(audio.resample(x)[: len(want)], want, atol=1e-4)


def test_links_at_exactly_the_similarity(spark):
    a = [f"w{k}" for k in range(10)]  # nine shingles of two words
    texts = [" ".join(a), " ".join([*a[:9], "x"]), " ".join([*a[:8], "y", "z"]), " ".join(a).upper()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows_of(texts), DOCS), shingle=2).collect()}
    assert got == {0: (9, 0), 1: (9, 0), 2: (9, 2), 3: (9, 0)}  # 8 of 10; 7 of 11; all


@pytest.fixture(scope="module")
def clashing(spark):
    """Nulls, a very long text, repeated rows, one id with two texts, and columns named like what operators add."""
    rng = random.Random(21)
    words = [f"word{k}" for k in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(200_000))
    rows = [(1, "a short text"), (1, "a short text"), (2, None), (None, "no id"), (None, None), (3, ""), (4, long), (5, "one text"), (5, "another text")] + [(10 + k, " ".join(rng.choice(words) for _ in range(60))) for k in range(20)]
    extra = [(*r, "x", "y", 1, 2.0, None, 3) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, row string, score string, id long, rate double, items string, hash long")


@pytest.fixture(scope="module")
def few_labels(spark):
    return spark.createDataFrame([(10 + k, k % 2, (k + 1) % 2) for k in range(20)] + [(1, 1, 0), (1, 0, 1), (4, 1, 0), (5, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda d, labels: near_duplicates(d),
    "op2": lambda d, labels: mixing.mix(d, mixing.label_domains(labels), mixing.TARGETS),
    "op3": lambda d, labels: decontam.contamination(d, d.select(d.doc_id.alias("item_id"), "text").where("doc_id < 4")),
    "op4": lambda d, labels: dedup_lines(d),
    "op5": lambda d, labels: tokens.read_tokens(tokens.write_tokens(d, str(TOKENIZERS.path("word_bpe_49k.json")))),
    "op7": lambda d, labels: lm.score_texts(d),
    "op8": lambda d, labels: quality.score_quality(d, quality.train_quality(d, labels)),
    "op9": lambda d, labels: toxicity.score_toxicity(d, toxicity.train_toxicity(d, labels)),
    "op10": lambda d, labels: audio.digest(audio.store(audio.audio_columns(d))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_no_rows(spark, clashing, few_labels, name):
    out = OPERATORS[name](clashing, few_labels)
    rows = out.collect()
    assert len(rows) == clashing.count()
    ids = collections.Counter(r["doc_id"] if "doc_id" in out.columns else r["row"]["doc_id"] for r in rows)
    assert ids == collections.Counter(r.doc_id for r in clashing.select("doc_id").collect())
    assert OPERATORS[name](clashing.limit(0), few_labels).count() == 0
    assert OPERATORS[name](clashing.where("doc_id > 10"), few_labels.limit(0)).count() == 19
