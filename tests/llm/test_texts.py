import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tidemark.llm import chat, common, fingerprints, language, packing, quality, tokens

ODD = ["", " ", "  a  b ", "<unk> x", "日本語 テキスト\U0001f600 x\n y", "▁a ▁▁b", "\t tab", "é ́x", "<|endoftext|> a<|startoftext|>b 'S it's", "ÀÉß x7²3 don't ×÷ a_b×c", "x<unk>日y", "STRASSE Straße µ ª", "a,b;c--d 12.5%"]


@pytest.fixture(scope="module")
def some(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


def test_ids_equal_the_tokenizers(some):
    encoder = tokens.WordTokens.load()
    want = encoder.tokenizer.encode_batch(some + ODD, add_special_tokens=False)
    assert all(list(a) == b.ids for a, b in zip(encoder.encode(some + ODD), want, strict=True))


def test_counts_equal_the_tokenizers(some, odd, spark):
    tk = Tokenizer(models.Unigram(tokens.read_vocabulary(), 0, False))
    tk.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = tokens.PieceCounter(tokens.read_vocabulary())
    assert [counter.count(t) for t in some + ODD] == [len(e.ids) for e in tk.encode_batch(some + ODD, add_special_tokens=False)]
    counted = tokens.count_pieces(odd).collect()
    assert [r.n_tokens for r in counted if r.text is None] == [0, 0]
    assert all(r.n_tokens == len(tk.encode(r.text or "", add_special_tokens=False).ids) for r in counted)


def test_tie_rules_by_brute_force():
    """Tiny vocabularies with many ties, against the tokenizer itself."""
    rnd = random.Random(4)
    for _ in range(40):
        pieces = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3))) for _ in range(8)}
        vocabulary = [("<unk>", 0.0), ("▁", -1.0)] + [(p, -float(rnd.randint(1, 3))) for p in sorted(pieces)]
        tk, counter = Tokenizer(models.Unigram(vocabulary, 0, False)), tokens.PieceCounter(vocabulary)
        tk.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        for _ in range(30):
            text = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 12)))
            assert counter.count(text) == len(tk.encode(text, add_special_tokens=False).ids), (vocabulary, text)


def check_packing(rows, docs, window=2048):
    encoder = tokens.WordTokens.load()
    ids = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids[r.doc_id].append(list(next(encoder.encode([r.text], 1))))
    places, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(places) == set(ids)
    for i, pieces in places.items():
        assert sum(p.length for p in pieces) == sum(map(len, ids[i]))
        if len(ids[i]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[i][0])
                assert p.ids_crc32 == zlib.crc32(np.array(ids[i][0][at : at + p.length], "<u4").tobytes())
                at += p.length
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return sum(sum(n for _, n in p) for p in sequences.values()) / (window * len(sequences))


def test_packing_round_trip(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert check_packing(packing.pack_documents(docs).collect(), docs) > 0.97
    check_packing(packing.pack_documents(odd).collect(), odd)
    check_packing(packing.pack_documents(odd, shard_rows=2).collect(), odd)
    assert packing.pack_documents(none).count() == 0


def test_neighbours_share_shards(spark, make):
    """With shards of 40 rows, the best neighbours over all documents, by brute force, are mostly in a document's shard; statistics are those of all."""
    rnd = random.Random(8)
    topics = [[f"{rnd.choice('bcdfgklmnprstvz')}{rnd.choice('aeiou')}{rnd.choice('bdgklmnprst')}{rnd.randrange(1000)}" for _ in range(30)] for _ in range(40)]
    texts = [" ".join(rnd.choice(topics[k % 40]) for _ in range(60)) for k in range(800)]
    rows = packing.pack_documents(make(*texts), shard_rows=40).collect()
    pieces = [np.array(x) for x in tokens.WordTokens.load().encode(texts, 1)]
    index = packing.InvertedIndex(pieces)
    shard = {r.doc_id: r.sequence_id >> 40 for r in rows}
    assert len(set(shard.values())) >= 15
    found = 0
    for q in range(0, 800, 8):
        score = index.scores(q)
        score[q] = -1
        found += sum(shard[int(k)] == shard[q] for k in np.argsort(-score, kind="stable")[:5])
    assert found / 500 > 0.4  # a twentieth by chance


def test_shards_are_cut_by_the_counts_of_all_documents(make):
    """Six thousand documents of six words: with shards of 100 rows, all shards have documents and none has many more than others."""
    rnd = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bcdfgklmnprstvz" for b in "aeiou" for c in "bdgklmnprst"]
    texts = [" ".join(rnd.sample(words, 6)) for _ in range(6000)]
    rows = packing.pack_documents(make(*texts), shard_rows=100).collect()
    shard = {r.doc_id: r.sequence_id >> 40 for r in rows}
    sizes = sorted(Counter(shard.values()).values())
    assert len(sizes) == 60 and sizes[0] >= 50, sizes


def test_neighbours_are_by_bm25():
    rnd = np.random.default_rng(2)
    pieces = [np.concatenate([rnd.integers(100 * k, 100 * k + 40, 50) for _ in range(2)]).astype(np.uint32) for k in (0, 1, 2, 0, 1, 2)]
    index = packing.InvertedIndex(pieces)
    n, size = len(pieces), [len(p) for p in pieces]
    for seed in range(n):
        want = []
        for j in range(n):
            score = 0.0
            for term in np.unique(pieces[seed]):
                df = sum(term in p for p in pieces)
                tf = (pieces[j] == term).sum()
                score += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[j] / np.mean(size)))
            want.append(score)
        assert index.scores(seed) == pytest.approx(want)
        assert np.argsort(-index.scores(seed))[1] == (seed + 3) % 6
    assert sorted(tuple(sorted(d for d, _, _ in s)) for s in packing.pack(size, pieces, 200)) == [(0, 3), (1, 4), (2, 5)]


def test_quality_learns_and_keeps_columns(spark, sf, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.fit(docs, labels)
    held = quality.op1_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in held)
    assert quality.score(odd, trees).columns[-2:] == ["quality_score", "quality_predicted"]
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert quality.score(none, trees).count() == 0
    assert quality.score(odd, quality.fit(none, labels)).select("quality_score").distinct().collect()[0][0] == 0.5


def plain_statistics(text):
    """The statistics one by one, without numpy."""
    raw = (text or "").encode()
    words, n = raw.split(), len(raw)
    if not words:
        return [math.log(1 + n)] + [0.0] * (len(quality.FEATURES) - 1)
    m, lengths, seen, each = len(words), [len(w) for w in words], Counter(raw), Counter(words)
    mean = sum(lengths) / m
    top = [c for _, c in each.most_common()]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda f: sum(c for b, c in seen.items() if f(b)) / n
    return [
        math.log(1 + n), math.log(1 + m), mean, math.sqrt(sum((x - mean) ** 2 for x in lengths) / m), share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b == 10),
        share(lambda b: b > 127), share(lambda b: b in quality._PUNCTUATION), -sum(c / n * math.log2(c / n) for c in seen.values()), max([c for b, c in seen.items() if b != 32], default=0) / n,
        len(each) / m, top[0] / m, sum(top[:5]) / m, top.count(1) / m, math.log(1 + m / len(lines)), 1 - len(set(lines)) / len(lines), sum(x <= 3 for x in lengths) / m, sum(x >= 12 for x in lengths) / m,
        sum(w[-1] in b".,;:!?*&$%#|" for w in words) / m, *[seen[b] / n for b in quality._PUNCTUATION],
    ]


def test_quality_scores_by_brute_force(spark, sf, some, odd):
    """All scores of the query from statistics and trees walked one by one; ties in every feature give equal scores."""
    texts = some[:60] + [r.text for r in odd.select("text").collect()]
    assert np.allclose(quality.statistics_of(texts), np.array([plain_statistics(t) for t in texts]), rtol=1e-4, atol=1e-5)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.op1_quality(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        x = quality.statistics_of([r.text])[0]
        total = trees.prior
        for at in trees.roots:
            for _ in range(trees.depth):
                at = trees.child[at] + int(x[trees.feature[at]] > trees.threshold[at])
            total += float(trees.value[at])
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-4)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
    same = quality.score(docs.limit(1).union(docs.limit(1)), trees).select("quality_score").distinct()
    assert same.count() == 1


def test_trees_equal_a_plain_walk():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(500, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.train(x, y, rounds=12, depth=3)
    scores = trees.score(x)
    for i in range(0, 500, 25):
        total = trees.prior
        for root in trees.roots:
            at = root
            for _ in range(trees.depth):
                at = trees.child[at] + int(x[i, trees.feature[at]] > trees.threshold[at])
            total += trees.value[at]
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-5)
    assert ((scores > 0.5) == y).mean() > 0.9


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language.fit(docs)
    held = language.identify(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), net).collect()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    rows = language.identify(odd, net).collect()
    assert all((r.lang_pred == "und") == (r.text is None or not any(map(str.isalpha, r.text))) for r in rows)
    assert language.identify(none, net).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.fit(none)).collect()} == {"und"}


def test_pooled_labels_by_brute_force(odd):
    """Every byte labelled by the training pass, window by window, and pooled."""
    texts = [r.text for r in odd.select("text").collect()] + ["a", "é" * 40, "x" * 64, "ab " * 50, "z\x00y"]
    rnd = np.random.default_rng(3)
    direction = lambda: language.Direction(rnd.normal(0, 0.4, (3, 256, 8)).astype(np.float32), rnd.normal(0, 0.4, (3, 8, 8)).astype(np.float32))
    net = language.Network(["de", "en", "fr"], direction(), direction(), rnd.normal(0, 0.5, (17, 3)).astype(np.float32))
    names, scores = net.label(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        if text is None or not any(map(str.isalpha, text)):
            assert (name, score) == ("und", 0.0)
            continue
        raw, total = text.encode(), np.zeros(3)
        for at in range(0, len(raw), language.WINDOW):
            x = np.zeros((language.WINDOW, 1), np.uint8)
            piece = np.frombuffer(raw[at : at + language.WINDOW], np.uint8)
            x[: len(piece), 0] = piece
            a, b = net.ahead.forward(x)[0], net.back.forward(x[::-1])[0][::-1]
            p = np.exp(np.concatenate([a, b, np.ones((*x.shape, 1))], axis=2) @ net.out)[:, 0]
            total += (p / p.sum(axis=1, keepdims=True))[: len(piece)][piece != 0].sum(axis=0) if len(piece) < language.WINDOW else (p / p.sum(axis=1, keepdims=True)).sum(axis=0)
        assert net.languages[total.argmax()] == name
        assert score == pytest.approx((total / total.sum()).max(), abs=1e-3)


def test_language_ties_and_samples(spark):
    rows = [(k, f"text number {k} of a language", ["aa", "bb", "cc"][k % 3] if k % 7 else None) for k in range(120)] + [(3, "another text of an id", "aa"), (None, "no id", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit(docs, 12)
    assert net.languages == ["aa", "bb", "cc"]
    assert language.fit(docs, 2).languages == ["aa", "bb"] and language.fit(docs.where("lang = 'cc'")).languages == ["cc"]
    net.out[:] = 0
    assert net.label(["words", "1 2", None]) [0] == ["aa", "und", "und"]  # equal shares: the first language
    assert {r.lang_pred for r in language.identify(docs.where("lang = 'cc'"), language.fit(docs.where("lang = 'cc'"))).collect()} == {"cc"}
    assert language.cut("abc", 1) == [b"abc"] and len(language.cut("abc" * 900, 1)) == language.CUTS


def test_gradients_by_differences():
    rnd = np.random.default_rng(0)
    d = language.Direction(rnd.normal(0, 0.5, (3, 256, 4)), rnd.normal(0, 0.5, (3, 4, 4)))
    x, up = rnd.integers(0, 256, (5, 3)), rnd.normal(size=(5, 3, 4))
    loss = lambda: float((d.forward(x)[0].astype(float) * up).sum())
    grads = d.backward(x, d.forward(x)[1], up)
    for weights, grad in zip((d.byte, d.state), grads, strict=True):
        for at in [tuple(int(rnd.integers(n)) for n in weights.shape) for _ in range(25)] + [(k, int(x[0, 0]), 1) for k in range(3) if weights.shape[1] == 256]:
            keep, step = weights[at], 1e-3
            weights[at] = keep + step
            high = loss()
            weights[at] = keep - step
            low = loss()
            weights[at] = keep
            assert grad[at] == pytest.approx((high - low) / (2 * step), abs=2e-2)
    assert np.abs(d.run(x) - d.forward(x)[0]).max() < 1e-5


def brute_fingerprints(docs):
    rows = sorted(((r.doc_id is None, -(r.doc_id or 0), fingerprint_z(r.text), r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()))
    out = []
    for k, (*_, i, t) in enumerate(rows):
        u = rows[(k + 1) % len(rows)][4]
        n = len(t) // 3
        edited = t[: len(t) - n] + u[:n]
        a, b, c = fingerprints.canonical(t), fingerprints.canonical(edited), fingerprints.canonical(u)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(a == b), float(a == c)))
    return out


def fingerprint_z(t):
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress((t or "").encode())


@pytest.mark.parametrize("bits", [128, 4])
def test_fingerprints_against_brute_force(odd, none, bits):
    got = fingerprints.fingerprint_pairs(odd.select("doc_id", "text"), bits).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    texts = {hashlib.sha256((r.text or "").encode()).hexdigest(): fingerprints.canonical(r.text) for r in odd.select("text").collect()}
    want = sorted(brute_fingerprints(odd), key=key)
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got], key=key) == want
    forms = {r.text: fingerprints.canonical(r.text) for r in odd.select("text").collect()}
    by_id = {r.doc_id: r.text for r in odd.select("doc_id", "text").collect() if r.doc_id is not None}
    prints = {r.fingerprint: set() for r in got}
    for r in got:
        if r.doc_id in by_id and list(x.doc_id for x in got).count(r.doc_id) == 1:
            prints[r.fingerprint].add(forms[by_id[r.doc_id]])
    assert all(len(x) <= 1 for x in prints.values())  # equal prints, equal forms, though four bits collide
    for r in got:  # an edited text has a document's print if and only if it has its form
        if r.edited_sha256 in texts:
            assert prints.get(r.edited_fingerprint, {texts[r.edited_sha256]}) == {texts[r.edited_sha256]}
        elif bits == 128:
            assert r.near_edited == 1 or r.edited_fingerprint not in prints
    assert fingerprints.fingerprint_pairs(none, bits).count() == 0


def test_canonical_folds():
    assert fingerprints.canonical("Ｆoo  BAR\n ﬁ") == fingerprints.canonical("foo bar fi") == b"foo bar fi"
    assert fingerprints.canonical(None) == b""


def test_chat_round_trip(spark):
    rnd = random.Random(6)
    parts = ["\\", "###", "</turn>", "### Assistant:\n", "</turn>\n", "<", "#", "ok", "\n", "\\\\", "é", "### Other(", ")"]
    data = []
    for c in [*range(30), None]:
        for turn in range(rnd.randint(1, 6)):
            text = None if rnd.random() < 0.1 else "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
            data.append((c, turn, rnd.choice(["user", "assistant", "system", "tool)(\\", None]), text, 1))
    data += data[:3]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, segment int")
    got = {r.conv_id: r for r in chat.read_back(chat.segments(frame)).collect()}
    low = lambda v: (v is not None, v)
    assert set(got) == {d[0] for d in data}
    for c, r in got.items():
        turns = sorted((d[1:4] for d in data if d[0] == c), key=lambda d: tuple(map(low, d)))
        spoken = "".join(t or "" for _, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(spoken)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role or ''}\n{t or ''}\n" for _, role, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
    assert chat.read_back(chat.segments(frame.limit(0))).count() == 0


@pytest.mark.parametrize(("roles", "valid"), [(["user", "assistant"], True), (["system", "user", "assistant"], True), (["user"], False), (["assistant", "user"], False), (["user", "user", "assistant"], False), (["user", "assistant", "system"], False)])
def test_machine_validates_order(spark, roles, valid):
    frame = spark.createDataFrame([(1, k, r, "x") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.segments(frame)).collect()[0].valid is valid


def test_other_templates_and_long_texts(spark):
    template = chat.Template(header="<|{role}|> ", footer="<|end|>\n", loss=frozenset({"user"}))
    said = "a <|end|>\n \\<| <|User|> " * 20_000
    frame = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", "<|en"), (2, 0, "assistant", None), (2, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.segments(frame, template), template).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n<|en\n".encode()).hexdigest()
    assert (got[1].loss_chars, got[1].valid, got[2].n_turns, got[2].valid) == (len(said), True, 2, False)
    for bad in ({"footer": "\\end"}, {"footer": "aba"}, {"header": "{role}:"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_usual_words_equal_the_tokenizers():
    encoder = tokens.WordTokens.load()
    some = ["Abc.", "abc,", "ABC", "a.", ".", ",", "..", "don't.", "x1.", "Été.", "", " Abc,  d. ", "q" * 3000 + "."]
    want = encoder.tokenizer.encode_batch(some, add_special_tokens=False)
    assert [x.tolist() for x in encoder.encode(some)] == [x.ids for x in want]


def test_lean_tasks_forget_what_other_kinds_keep():
    seen = []
    common.kept("some kind")["a"] = 1
    assert list(common.lean(lambda batches: (seen.append(dict(common.kept("some kind"))) or b for b in batches), "some kind")([1, 2])) == [1, 2]
    assert seen == [{"a": 1}] * 2
    assert list(common.lean(lambda batches: iter(batches))([3])) == [3]
    assert common.kept("some kind") == {}
