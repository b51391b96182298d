import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard, passages


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_rows(rows):
    """Of each row (id, size, smallest id that links reach); rows that share an id are rows of their own."""
    rows = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (i, a) in enumerate(rows):
        for m, (j, b) in enumerate(rows[:k]):
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(k), top(m)), key=lambda n: (rows[n][0], n))
                root[y] = x
    return [(i, len(s), rows[top(k)][0]) for k, (i, s) in enumerate(rows)]


def brute(rows):
    """doc_id -> (size, smallest id that links reach)."""
    return {i: (n, top) for i, n, top in brute_rows(rows)}


def corpus(seed, groups=12, size=60):
    """Groups of texts with ever more edits, so that similarities lie on both sides of the threshold; a passage shared by
    many; copies that differ in case; short texts; long chains of links."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(30)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([3, 6, 9, 14, 40, 160]))]
        if rnd.random() < 0.5:
            base += common
        for _ in range(rnd.randint(1, size // groups)):
            new = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 25)):
                new[rnd.randrange(len(new))] = word()
            texts.append(" ".join(new) if rnd.random() < 0.8 else " ".join(new).upper())
            base = new if rnd.random() < 0.3 else base
    texts += ["", None, "a b", "a b", "A B", "a b c d e", "a b c d e f"]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("hot", [48, 2])
def test_against_brute_force(spark, make, hot):
    """With two documents to a hot segment nearly every document takes the second path."""
    docs = make(*corpus(hot, groups=30, size=200), start=100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, hot=hot).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_blocks_and_large_groups(make):
    rnd = random.Random(1)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for _ in range(60):
        new = list(base)
        for _ in range(rnd.randint(0, 6)):
            new[rnd.randrange(90)] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(new))
    docs = make(*texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, hot=4, block=8).collect()}
    assert got == brute(list(enumerate(texts)))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 20, 60, 300])
def test_pigeonhole(n):
    """Any two sets at the threshold share as many signatures as their layout asks, if one of them has the capacity."""
    rng = np.random.default_rng(n)
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        keep = rng.permutation(a)
        low = next(k for k in range(n, -1, -1) if 100 * k < 75 * n)
        b = np.unique(np.r_[keep[: low + 1], np.zeros(0, np.uint64)]) if rng.random() < 0.5 else np.unique(np.r_[a, rng.integers(0, 2**63, n // 3, dtype=np.uint64)])
        small, large = sorted((a, b), key=len)
        shared = len(np.intersect1d(small, large))
        if 100 * shared < 75 * (len(small) + len(large) - shared) or not len(small):
            continue
        band = int(jaccard.band_of(np.array([len(small)]))[0])
        sig, of, room = jaccard.signatures([small, large], band)
        asked = jaccard.layout(band)[2]
        for k, s in enumerate((small, large)):
            if room[k] >= jaccard.differences(np.array([len(s)]), band)[0] + asked:
                assert len(np.intersect1d(sig[of == 0], sig[of == 1])) >= asked


def test_layouts_use_neighbourhoods_where_they_are_cheaper():
    assert any(jaccard.layout(b)[1] for b in range(6))
    assert all(jaccard.layout(b)[0] >= 1 for b in range(30))


def test_odd_and_empty(odd, none):
    got = jaccard.near_duplicates(odd).collect()
    assert Counter(map(tuple, got)) == Counter(brute_rows([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]))
    assert jaccard.near_duplicates(none).count() == 0 and jaccard.keep_one(none).count() == 0


@pytest.mark.parametrize("hot", [48, 1])
def test_ids_that_repeat_with_different_texts(spark, hot):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    bases = [[word() for _ in range(80)] for _ in range(6)]
    rows = []
    for k in range(60):
        new = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 4)):
            new[rnd.randrange(80)] = word()
        rows.append((rnd.randrange(12), " ".join(new)))
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.near_duplicates(docs, hot=hot, block=4).collect())) == Counter(brute_rows(rows))


def test_keep_one_keeps_one_row_of_each_component(spark, odd):
    z, other, changed = (" ".join(f"{c}{k}" for k in range(40)) for c in "zab")
    near = changed.replace("b39", "b40")
    rows = [(1, z, "x"), (5, z, "x"), (5, other, "y"), (7, changed, "z"), (7, near, "z"), (7, near, "z"), (8, "", "e"), (8, "", "e"), (None, z, "n"), (None, None, "n")]
    left = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, own string"))
    got = Counter(map(tuple, left.collect()))
    (seven,) = [r for r in got if r[0] == 7]
    assert got == Counter([(1, z, "x"), (5, other, "y"), seven, (8, "", "e"), (8, "", "e"), (None, z, "n"), (None, None, "n")])
    left = jaccard.keep_one(odd)
    assert left.columns == odd.columns
    tops = [(i, n, top) for i, n, top in brute_rows([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])]
    assert left.count() == sum(1 for i, n, _ in tops if not n or i is None) + _components_of(odd)


def _components_of(odd):
    """Components of rows with shingles and id, by their texts."""
    texts = sorted({(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if r.doc_id is not None and shingles(r.text)})
    sets, found = [shingles(t) for _, t in texts], 0
    seen = set()
    for k in range(len(sets)):
        if k not in seen:
            found, stack = found + 1, [k]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack += [y for y in range(len(sets)) if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])]
    return found


def naive_chain_score(a, b):
    best = [0.0] * len(a)
    for j in range(len(a)):
        best[j] = float(passages.K)
        for i in range(j):
            if a[i] < a[j] and b[i] < b[j]:
                gap = passages.GAP_COST * (a[j] - a[i] + b[j] - b[i] - 2 * passages.K)
                best[j] = max(best[j], best[i] + passages.K - gap) if best[i] - gap > 0 else best[j]
    return max(best, default=0)


def test_fenwick_chains_are_the_best():
    rnd = random.Random(2)
    for _ in range(60):
        anchors = sorted({(rnd.randrange(40), rnd.randrange(40)) for _ in range(rnd.randint(2, 14))})
        a, b = [x for x, _ in anchors], [y for _, y in anchors]
        chains = passages.chain(a, b)
        scores = []
        for links in chains:
            assert all(a[i] < a[j] and b[i] < b[j] for i, j in zip(links, links[1:]))
            scores.append(passages.K * len(links) - sum(passages.GAP_COST * (a[j] - a[i] + b[j] - b[i] - 2 * passages.K) for i, j in zip(links, links[1:])))
        assert max(scores, default=passages.K) == pytest.approx(naive_chain_score(a, b))


def test_alignment_spans_edits():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 2**32, 200, dtype=np.uint32)
    y = np.r_[rnd.integers(0, 2**32, 30, dtype=np.uint32), x[50:100], rnd.integers(0, 2**32, 2, dtype=np.uint32), x[101:150], rnd.integers(0, 2**32, 30, dtype=np.uint32)]
    begin_x, end_x, begin_y, end_y, length, equal = passages.align(x, y, np.array([[60, 120], [40, 101]], np.int32))
    assert (begin_x, end_x, begin_y, end_y) == (50, 150, 30, 131)
    assert equal == 99 and length == 101


def test_planted_passages(make, odd, none):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts = [[word() for _ in range(rnd.randint(60, 200))] for _ in range(40)]
    passage = [word() for _ in range(60)]
    spots = {}
    for d in (3, 9, 17, 30):
        copy = list(passage)
        for _ in range(2 if d != 3 else 0):
            copy[rnd.randrange(60)] = word()
        at = rnd.randrange(len(texts[d]))
        texts[d][at:at] = copy
        spots[d] = at
    found = passages.repeated_passages(make(*[" ".join(t) for t in texts])).collect()
    flagged = {r.doc_id for r in found} | {r.first_doc_id for r in found}
    assert flagged == set(spots)
    for r in found:
        for doc, low, high in ((r.doc_id, r.start, r.end), (r.first_doc_id, r.first_start, r.first_end)):
            assert abs(low - spots[doc]) <= 3 and abs(high - spots[doc] - 60) <= 3
    got = passages.repeated_passages(odd).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(7, 6), (50, 6), (50, 7)}
    assert passages.repeated_passages(none).count() == 0


def test_passages_with_changed_words(make):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts, wanted = [], set()
    for n in (60, 80, 100):
        for changed in [range(0, n, 6), range(4, n, 5), *(sorted(rnd.sample(range(n), n * share // 100)) for share in (5, 10, 10, 15, 15) for _ in range(2))]:
            passage = [word() for _ in range(n)]
            copy = [word() if k in changed else w for k, w in enumerate(passage)]
            wanted.add((len(texts) + 1, len(texts)))
            texts += [[word() for _ in range(40)] + p + [word() for _ in range(40)] for p in (passage, copy)]
    found = passages.repeated_passages(make(*[" ".join(t) for t in texts])).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == wanted
    for r in found:
        assert r.words >= 45 and r.identity >= 0.8


def test_stretches_of_a_long_chain():
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 2**32, 300, dtype=np.uint32)
    y = x.copy()
    y[[*range(0, 100, 2), *range(160, 300, 2)]] = 0
    low, high, *_, length, equal = passages.stretches(x, y, np.array([[101, 120, 150], [101, 120, 150]], np.int32))[0]
    assert low <= 100 and high >= 160 and length == high - low and equal >= 0.8 * length


@pytest.mark.parametrize("crowd", [1, 12])
def test_passage_whose_seeds_have_other_leaders(make, crowd):
    """Each half of the passage is led by older documents that have 40 words of it only; with a crowd, every short seed is hot."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    own = lambda: [word() for _ in range(50)]
    passage = own() + own()[:10]
    texts = [own() + passage[:40] + own() for _ in range(crowd)] + [own() + passage[20:] + own() for _ in range(crowd)]
    b, c = len(texts), len(texts) + 1
    texts += [own() + passage + own() for _ in range(2)]
    found = passages.repeated_passages(make(*[" ".join(t) for t in texts])).collect()
    assert [(r.doc_id, r.first_doc_id, r.start, r.end) for r in found] == [(c, b, 50, 110)]


@pytest.mark.parametrize("length", [45, 50, 60])
def test_exact_passages_whose_seeds_are_all_frequent(make, length):
    """Sixty pairs of documents share an exact passage; every slice of thirty words of it stands in ten others too, so that all short seeds are led by those."""
    rnd = random.Random(length)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    own = lambda: [word() for _ in range(30)]
    texts, wanted = [], set()
    for _ in range(60):
        passage = [word() for _ in range(length)]
        texts += [own() + passage[at : at + 30] + own() for at in {*range(0, length - 30, 10), length - 30} for _ in range(10)]
        wanted.add((len(texts) + 1, len(texts)))
        texts += [own() + passage + own() for _ in range(2)]
    found = passages.repeated_passages(make(*[" ".join(t) for t in texts])).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == wanted
    assert all(30 <= r.start <= 30 + 1 and r.end - r.start >= length - 1 for r in found)


@pytest.mark.parametrize("block", [8192, 5])
def test_changed_passages_whose_seeds_are_all_frequent(make, monkeypatch, block):
    """Twenty pairs of documents share a passage of which the second has every twelfth word changed; every slice of thirty words of both stands in ten others too, so that all seeds of the pair are led by those."""
    monkeypatch.setattr(passages, "BLOCK", block)
    rnd = random.Random(77)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    own = lambda: [word() for _ in range(30)]
    texts, wanted = [], set()
    for _ in range(20):
        passage = [word() for _ in range(60)]
        copy = [word() if k % 12 == 6 else w for k, w in enumerate(passage)]
        texts += [own() + p[at : at + 30] + own() for p in (passage, copy) for at in (0, 10, 20, 30) for _ in range(10)]
        wanted.add((len(texts) + 1, len(texts)))
        texts += [own() + p + own() for p in (passage, copy)]
    found = passages.repeated_passages(make(*[" ".join(t) for t in texts])).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == wanted
    assert all(abs(r.start - 30) <= 1 and abs(r.end - 90) <= 1 for r in found)


def test_hashes_of_words_are_remembered_and_right(monkeypatch):
    """Whatever shares a slot, in texts cut into pieces or not; A-Z alone is lower-cased, and ASCII blanks alone part words."""
    monkeypatch.setattr(passages.Words, "SLOTS", 3)
    monkeypatch.setattr(passages.Words, "PIECE", 50)
    rnd, make = random.Random(43), passages.Words()
    texts = [None, "", " ", "\n\t a", "a", " A\x0bB\x0c\u00c9 x \ud800 y\r\n", "x" * 300 + " y", "\u2003 q\u00a0r\x1cs"]
    texts += ["".join(rnd.choice("abAB \n\u00c9") for _ in range(rnd.randrange(200))) for _ in range(200)]
    for text in texts * 2:
        want = [passages.xxhash.xxh3_64_intdigest(w) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
        assert make.of(text).tolist() == want


def test_long_runs_of_words_make_rows_by_their_length(make):
    """Runs of a word, or of three in turn, in twelve documents, one of them ten times as long as the others: all their words are in passages, and rows grow with the runs' lengths, not with the product of runs."""
    texts, covered = [], []
    for n, turn in enumerate((["la"], ["so", "fa", "re"], ["mi"], ["do"], ["ti"])):
        for k, length in enumerate([*range(60, 93, 3), 630]):
            texts.append([f"a{n}x{k}y{j}" for j in range(20)] + turn * (length // len(turn)) + [f"b{n}x{k}y{j}" for j in range(20)])
            covered.append(np.zeros(len(texts[-1]), bool))
    found = passages.repeated_passages(make(*[" ".join(t) for t in texts])).collect()
    for r in found:
        covered[r.doc_id][r.start : r.end] = True
        covered[r.first_doc_id][r.first_start : r.first_end] = True
    assert all(c.sum() == len(c) - 40 and not c[:20].any() and not c[-20:].any() for c in covered)
    assert len(found) <= sum(len(t) for t in texts) / passages.MIN_WORDS


def test_pieces_of_a_run_cover_it():
    """Laid against another run, longer or shorter, the pieces of a run leave nothing out, and each is a passage."""
    rnd, least, k, margin = random.Random(42), passages.MIN_WORDS, passages.K, passages.MARGIN
    names = ["cls", "low", "high", "step", "other", "other_low", "other_high"]
    for n in range(400):
        step = rnd.randint(1, passages.PERIOD)
        (low, high), (begin, end) = ((x, x + -(-(least - k + rnd.choice((0, rnd.randrange(30), rnd.randrange(600)))) // step) * step) for x in (rnd.randrange(50), rnd.randrange(50)))
        row = dict(zip(names, (n % 2 * 2, low, high, step, 1, begin, end), strict=True))
        made = [r for batch in passages._tiles(iter([pa.RecordBatch.from_pylist([row])])) for r in batch.to_pylist()]
        covered = np.zeros(high + k, bool)
        for r in made:
            at = np.frombuffer(r["anchors"], np.int32).tolist()
            mine, its = at if r["a"] == row["cls"] else at[::-1]
            assert low <= mine <= high and begin <= its <= end and (mine - low) % step == (its - begin) % step == 0
            left, right = min(mine - low, its - begin, margin), min(high - mine, end - its, margin)
            assert left + k + right >= least
            covered[mine - left : mine + k + right] = True
        assert covered[low:].all() and len({(r["a"], r["b"], r["nth"]) for r in made}) == len(made) <= 3 + (high - low) / 30


def test_copies_in_a_run_answer_once_and_ask_in_turn():
    """Occurrences in the middle of a run look alike; those near its ends, and lines that come again further off, stay themselves."""
    words = np.r_[np.arange(1, 101), np.full(400, 7), np.arange(200, 301), np.arange(200, 301)].astype(np.uint64) << np.uint64(56)
    at = np.r_[100:494, 530, 631]
    seed = np.r_[np.zeros(394, np.int64), 1, 1]
    steps = passages._steps(seed, at, np.ones(len(at), bool))
    answers, asks = passages._copies(words, seed, at, passages._beside(words, at), steps)
    inside = at[(at >= 100 + passages.FAR) & (at <= 493 - passages.FAR)]
    assert answers.sum() == len(at) - len(inside) + 1 and answers[[0, -3, -2, -1]].all()
    asking = at[asks]
    assert asks[(at < inside[0]) | (at > inside[-1])].all() and len(asking) < len(at) - len(inside) / 2 and np.diff(asking[:-2]).max() <= passages.BESIDE


def test_words_beside_a_seed_allow_a_passage_or_not():
    """No passage that a lone anchor is aligned to is lost by the words beside it; few anchors that can be none are left. Sides that end and words that repeat included."""
    rnd, k, far = random.Random(41), passages.K, passages.FAR
    vocabulary = np.array([rnd.getrandbits(64) for _ in range(40)], np.uint64)
    beside, pairs = [], []
    for changed in (0.0, 0.1, 0.15, 0.2, 0.3, 0.6) * 40:
        x = vocabulary[[rnd.randrange(40) for _ in range(rnd.choice((60, 90, 160)))]]
        y = np.array([rnd.getrandbits(64) if rnd.random() < changed else w for w in x.tolist()], np.uint64)
        at = rnd.randrange(len(x) - k + 1)
        y[at : at + k] = x[at : at + k]
        beside += [passages._beside(w, np.array([at])) for w in (x, y)]
        found = passages.stretches(x[max(0, at - 60) : at + k + 60].astype(np.uint32), y[max(0, at - 60) : at + k + 60].astype(np.uint32), np.full((2, 1), min(at, 60)))
        pairs.append(any(min(r[1] - r[0], r[3] - r[2]) >= passages.MIN_WORDS and r[5] >= passages.MIN_IDENTITY * r[4] for r in found))
    sides = passages._Beside(np.concatenate(beside))
    x, y, whole = np.arange(0, len(beside), 2), np.arange(1, len(beside), 2), np.array(pairs)
    alone = sides.alone(x, y)
    assert whole.sum() > 60 and alone[whole].all() and 0 < (alone & ~whole).sum() < (~whole).sum() / 2
    assert np.array_equal(sides.alone(y, x), alone)
    near = {(int(p), int(q)) for i, j in sides.near(x, y, 64) for p, q in zip(x[i], y[j], strict=True)}
    alike = set(x[sides.alike(x, y)].tolist())
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        (right, left), ends = ((np.r_[0, np.cumsum(same)] for same in (sides.plain[p] != sides.plain[q]).reshape(2, far)), (sides.plain[p].reshape(2, far) > 0).sum(axis=1))
        if any(right[r] + left[passages.BESIDE - r] <= passages.DIFFER for r in range(passages.BESIDE + 1) if r <= ends[0] and passages.BESIDE - r <= ends[1]):
            assert (p, q) in near and p in alike


def test_chains_of_lone_anchors():
    """A chain of one anchor goes on only if its diagonal can be a passage; longer ones always do."""
    row = lambda b, at, alone: {"bucket": 0, "a": np.array([1] * len(at)).tobytes(), "b": np.array([b] * len(at)).tobytes(), "at_a": np.array(at, np.int32).tobytes(), "at_b": np.array(at, np.int32).tobytes(), "alone": alone}
    made = [r for batch in passages._chained([row(2, [5], b"0"), row(3, [5], b"1"), row(4, [5, 14], b"0"), row(5, [5, 500], b"0"), row(6, [5], b"0"), row(6, [500], b"1")], 1) for r in batch.to_pylist()]
    assert [(r["b"], np.frombuffer(r["anchors"], np.int32).reshape(2, -1)[0].tolist()) for r in made] == [(3, [5]), (4, [5, 14]), (6, [500])]


def test_passage_of_frequent_lines(make):
    """Ten lines are in all documents, in two documents in one order."""
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    lines = [[word() for _ in range(8)] for _ in range(10)]
    texts = []
    for _ in range(30):
        texts.append([w for line in rnd.sample(lines, 10) for w in [*line, word()]])
    shared = [w for line in lines for w in line]
    texts += [[word() for _ in range(50)] + shared + [word() for _ in range(50)] for _ in range(2)]
    found = passages.repeated_passages(make(*[" ".join(t) for t in texts])).collect()
    assert (31, 30) in {(r.doc_id, r.first_doc_id) for r in found}


def test_components(spark):
    from tidemark.llm.graph import components

    rnd = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + rnd.randrange(40), 100 + rnd.randrange(40)) for _ in range(25)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = defaultdict(lambda: None)
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for start in sorted(near):
        stack = [start] if root[start] is None else []
        while stack:
            x = stack.pop()
            if root[x] is None:
                root[x] = start
                stack += near[x]
    assert got == {k: v for k, v in root.items() if v is not None}


def test_passages_of_ids_that_repeat(spark):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    own = lambda n: [word() for _ in range(n)]
    p, q = own(60), own(70)
    rows = [(1, own(20) + p + own(9)), (1, own(30) + q), (2, own(7) + p), (3, q + own(40)), (3, q + own(40)), (None, q)]
    rows = [(i, " ".join(t)) for i, t in rows] + [(4, " ".join(p)), (4, " ".join(p).upper()), (5, " ".join(p))]
    got = passages.repeated_passages(spark.createDataFrame(rows + rows[:2], "doc_id long, text string")).collect()
    assert {(2, 7, 67, 1, 20, 80), (4, 0, 60, 1, 20, 80), (3, 0, 70, 1, 30, 100), (3, 0, 70, 3, 0, 70), (5, 0, 60, 4, 0, 60)} <= {tuple(r[:6]) for r in got}
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(2, 1), (4, 1), (4, 2), (4, 4), (3, 1), (3, 3), (5, 4)}


def covered_by_brute_force(texts):
    """Of each document the words in a window of 45 that another document has, word by word, with 36 or more equal, of them three or more of the five at each end."""
    n, need = passages.MIN_WORDS, round(passages.MIN_WORDS * passages.MIN_IDENTITY)
    codes = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    texts = [np.array([codes[w] for w in t]) for t in texts]
    covered = [np.zeros(len(t), bool) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            for shift in range(n - len(b), len(a) - n + 1):
                low, high = max(0, shift), min(len(a), len(b) + shift)
                total = np.r_[0, np.cumsum(a[low:high] == b[low - shift : high - shift])]
                if len(total) > n:
                    head, tail = total[5 : len(total) - n + 5] - total[:-n], total[n:] - total[n - 5 : -5]
                    for at in np.flatnonzero((total[n:] - total[:-n] >= need) & (head >= 3) & (tail >= 3)) + low:
                        covered[i][at : at + n] = True
                        covered[j][at - shift : at - shift + n] = True
    return covered


def test_passages_cover_what_brute_force_finds(make):
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(3))
    texts = [[word() for _ in range(rnd.randint(50, 140))] for _ in range(44)]
    for _ in range(9):
        passage = [word() for _ in range(rnd.randint(46, 90))]
        for d in rnd.sample(range(44), rnd.choice([2, 2, 3, 12])):
            at = rnd.randrange(len(texts[d]) + 1)
            texts[d][at:at] = [word() if rnd.random() < 0.06 else w for w in passage]
    want = covered_by_brute_force(texts)
    got = [np.zeros(len(t), bool) for t in texts]
    for r in passages.repeated_passages(make(*[" ".join(t) for t in texts])).collect():
        got[r.doc_id][r.start : r.end] = True
        got[r.first_doc_id][r.first_start : r.first_end] = True
    both = sum((w & g).sum() for w, g in zip(want, got, strict=True))
    print(both, sum(w.sum() for w in want), sum(g.sum() for g in got))
    assert both >= 0.95 * sum(w.sum() for w in want) and both >= 0.95 * sum(g.sum() for g in got)
