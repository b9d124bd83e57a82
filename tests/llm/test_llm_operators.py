"""Operators against plain models, and on nulls, empty, long, tied and repeated rows with clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marginalia.llm import bpe, decontaminate, html_text, line_dedup, ngram_join, quality, section_tokens, suffix_tree_lm, toxicity, wavelet

PATH = public_tokenizers.path("byte_bpe_50k.json")
KINDS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, ids string, node string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z", "w") for i, t in rows], KINDS)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    w = ["the", "of", "ba", "ti", "on", "re", "an", "es", "lo", "Mu", "é", "ñu"]
    word = lambda: "".join(r.choice(w) for _ in range(r.randint(1, 3)))
    texts = ["\n".join(" ".join(word() for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 6))) for _ in range(60)]
    near = [t.replace("the", "thee", 1) for t in texts[:12]]
    odd = [None, "", " ", "a", "one two", "a  b \n\n c", "x<|endoftext|>y", "\n\n", "日本 語 😀", texts[0], texts[0], "long " * 30_000]
    return [*enumerate([*texts, *near, *odd]), (3, texts[5]), (3, texts[5]), (None, texts[7])]


def test_bpe_equals_library(spark, rows):
    lib = Tokenizer.from_file(PATH)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(table(spark, rows), PATH).collect()}
    want = set()
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == want


def test_prefix_encoder_on_noise():
    lib, enc, r = Tokenizer.from_file(PATH), bpe.TextEncoder(PATH), random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("ab \n\t.,'sé日😀<|>12 \x85\x1c") for _ in range(r.randint(0, 40)))
        assert enc.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_section_tokens(spark, rows):
    lib = Tokenizer.from_file(PATH)
    total = Counter()
    for r in section_tokens.count_by_section(table(spark, [x for x in rows if x[0] not in (3, None)]), PATH).collect():
        total[r.doc_id] += r.n_tokens
    for i, t in rows:
        if i not in (3, None):
            assert total[i] == len(lib.encode(t or "", add_special_tokens=False).ids)
    spans = np.array([(0, 2), (2, 5), (5, 6)])
    n, crossing = section_tokens.attribute(spans, np.array([0, 3]), 6)
    assert n.tolist() == [1, 2] and crossing.tolist() == [0, 1]


def test_section_tokens_one_by_one(spark, rows):
    """Every section's interval, tokens and crossing tokens against the library's offsets, row by row."""
    lib = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        t = t or ""
        cuts = [0, *(k + 1 for k, c in enumerate(t) if c == "\n" and k + 1 < len(t)), len(t)]
        n, crossing = [0] * (len(cuts) - 1), [0] * (len(cuts) - 1)
        offsets = lib.encode(t, add_special_tokens=False).offsets
        for a, b in offsets:
            shares = [min(b, hi) - max(a, lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]
            at = shares.index(max(shares))
            n[at] += 1
            crossing[at] += sum(x > 0 for x in shares) > 1
        want += [(str(i), k, cuts[k], cuts[k + 1], n[k], crossing[k], len(offsets)) for k in range(len(n))]
    got = [(str(r.doc_id), r.section, r.char_start, r.char_end, r.n_tokens, r.n_crossing, r.doc_tokens) for r in section_tokens.count_by_section(table(spark, rows), PATH).collect()]
    assert sorted(got) == sorted(want)


def test_wavelet_matrix():
    r = np.random.default_rng(2)
    for n, top in ((1, 1), (7, 3), (1000, 5), (5000, 50_000)):
        ids = r.integers(0, top, n).astype(np.uint16)
        m = wavelet.WaveletMatrix.build(ids, max(1, int(ids.max()).bit_length()))
        assert m.all().tolist() == ids.tolist()
        for i in r.integers(0, n, 20):
            v = int(ids[i])
            assert m.access(int(i)) == v and m.count(v) == int((ids == v).sum()) and m.rank(v, 0, int(i)) == int((ids[:i] == v).sum())
            assert m.select(v, m.rank(v, 0, int(i))) == i
        assert list(m.occurrences(int(ids[0]))) == np.flatnonzero(ids == ids[0]).tolist()


def test_wavelet_planes_cost_less_than_by_masks():
    """The splits take most of what writing the files costs beside the encoding."""
    import time

    def masks(ids):
        planes, seq = [], ids
        for k in range(15, -1, -1):
            one = (seq >> k) & 1 == 1
            planes.append(np.packbits(one, bitorder="little"))
            seq = np.concatenate([seq[~one], seq[one]])
        return planes

    def best(f):
        took = []
        for _ in range(7):
            began = time.process_time()
            found = f()
            took.append(time.process_time() - began)
        return min(took), found

    ids = np.random.default_rng(3).integers(0, 50_000, wavelet.BLOCK).astype(np.uint16)
    plain, want = best(lambda: masks(ids))
    built, got = best(lambda: wavelet.WaveletMatrix.build(ids, 16))
    assert all((a == b).all() for a, b in zip(got.planes, want, strict=True)) and built < 0.75 * plain


def test_token_files(spark, rows):
    lib = Tokenizer.from_file(PATH)
    got = wavelet.token_table(table(spark, rows), PATH).orderBy("start").collect()
    start = 0
    for (i, t), g in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_lookups_in_token_files(spark, rows, tmp_path):
    """Access, counts and occurrences from the files alone, with several parts in a shard."""
    lib, folder = Tokenizer.from_file(PATH), str(tmp_path / "tokens")
    wavelet.write_shards(table(spark, rows), folder, PATH, shards=3)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    ids = [i for _, t in order for i in [*lib.encode(t or "", add_special_tokens=False).ids, 0]]
    some = [0, 1, 17, len(ids) // 2, len(ids) - 1]
    asked = spark.createDataFrame([(p,) for p in [*some, some[0], -1, len(ids)]], "place long")
    assert sorted(map(tuple, wavelet.access(spark, folder, asked).collect())) == [(p, ids[p]) for p in some]
    for token in (0, ids[3], 50_255):
        assert sorted(r.place for r in wavelet.occurrences(spark, folder, token).collect()) == [k for k, i in enumerate(ids) if i == token]
        assert wavelet.count_token(spark, folder, token).first().n == ids.count(token)
    got = {(r.doc_id, r.start): r.ids for r in wavelet.read_shards(spark, folder).collect()}
    assert [i for _, found in sorted(got.items(), key=lambda x: x[0][1]) for i in found] == ids


def test_empty_token_files(spark):
    assert wavelet.token_table(table(spark, []), PATH).count() == 0


def test_language_model(spark, rows):
    got = suffix_tree_lm.score_documents(table(spark, rows)).collect()
    trained = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    count = Counter(w for i, t in rows if trained(i) for w in [*suffix_tree_lm.tokens(t), suffix_tree_lm.END])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        w = [*suffix_tree_lm.tokens(t), suffix_tree_lm.END]
        want.append((i or -1, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4), not trained(i)))
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), r.held_out) for r in got) == sorted(want)
    assert all(r.score <= 0 for r in got)


def test_states_are_distributions(spark):
    """Of the stored tables: what a retained state has for its transitions and its share of the parent's rest make one."""
    m, r = suffix_tree_lm, random.Random(8)
    texts = [" ".join(r.choice(["a b c d", "b c a", "a a b", "d", "c d a b"]) for _ in range(r.randint(1, 9))) for _ in range(80)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    count = Counter(w for t in texts for w in [*m.tokens(t), m.END])
    divisor = count.total() + 0.1 * (len(count) + 1)
    words = train.mapInArrow(m._count_words, "gram long, n long").groupBy("gram").sum("n").toDF("gram", "n")
    states = {x.gram: (x.value, x.rest) for x in m._states(train, words, divisor).collect()}
    lp = [{x.gram: math.log10((x.n + 0.1) / divisor) for x in words.collect()}]
    assert abs(sum(10**v for v in lp[0].values()) + 0.1 / divisor - 1) < 1e-9
    grams, left = m._grams(texts)
    n_states = 0
    for d in range(1, m.DEPTH + 1):
        seen = {(int(grams[d - 1][k]), int(grams[d][k]), int(grams[d - 1][k + 1])) for k in np.flatnonzero(left > d)}
        follow, lp_d = {}, {}
        for context, gram, shorter in seen:
            value, rest = states.get(gram, (None, None))[0], states.get(context, (None, None))[1]
            parent = lp[-1][shorter]
            lp_d[gram] = parent if rest is None else value if value is not None else rest + parent
            if rest is not None and value is not None:
                follow.setdefault(context, []).append((value, parent))
        for context, both in follow.items():
            rest = 10 ** states[context][1]
            assert abs(sum(10**v for v, _ in both) + rest * (1 - sum(10**p for _, p in both)) - 1) < 1e-4  # kept as single floats
            n_states += 1
        lp.append(lp_d)
    assert n_states > 10


def test_distinct_keys_are_not_sorted_again_and_again(monkeypatch):
    """Work on the n-grams of a block grows with them, however many are distinct."""
    monkeypatch.setattr(suffix_tree_lm, "HELD", 100)
    rng, found, seen = np.random.default_rng(1), suffix_tree_lm.Distinct(), []
    for _ in range(2000):
        seen.append(rng.integers(-(1 << 40), 1 << 40, 50))
        found.add(seen[-1])
    assert np.array_equal(found.all(), np.unique(np.concatenate(seen))) and found.sorted < 4 * 100_000
    assert len(suffix_tree_lm.Distinct().all()) == 0


def test_blocks_ask_in_runs_of_bytes(spark, rows):
    """No row for each n-gram that a block asks for: they were joined and sent row by row."""
    plan = suffix_tree_lm.score_documents(table(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and "gram" not in plan.split("FlatMapCoGroupsInArrow")[1]


def test_answers_find_what_is_there():
    m, r = suffix_tree_lm, np.random.default_rng(4)
    top = (1 << 64) - 1
    for keys in (np.unique(r.integers(0, top, 5000, dtype=np.uint64)), np.array([0, 1, 2, 3, top - 1, top], np.uint64), np.zeros(0, np.uint64)):
        model = {int(k): v for k, v in zip(keys, r.choice([np.nan, 1.0, 2.0], (len(keys), 3)), strict=True) if not np.isnan(v).all()}
        held = m.Answers(np.array(list(model), np.uint64), *(np.array([v[k] for v in model.values()], kind) for k, kind in enumerate((float, np.float32, np.float32))))
        asked = np.unique(np.concatenate([keys[::2], np.array([0, top], np.uint64), r.integers(0, top, 50, dtype=np.uint64)]))
        names = ["keys", "has", "n", "value", "rest"]
        parts = [(shard, *held.sent(part)) for shard, part in ((1, asked[len(asked) // 2 :]), (0, asked[: len(asked) // 2]))]
        rows = pa.table([pa.array([x[0] for x in parts]), *(pa.array([x[k] for x in parts], pa.binary()) for k in range(1, 6))], ["shard", *names])
        got = m.Answers.of_rows(rows)
        assert got.keys[:-1].tolist() == [k for k in asked.tolist() if k in model]
        at = got.find(asked.view(np.int64))
        for k, col in enumerate((got.n, got.value, got.rest)):
            np.testing.assert_array_equal(col[at].astype(float), [model.get(x, [np.nan] * 3)[k] for x in asked.tolist()])


def test_counts_come_back_from_their_bytes():
    m, r = suffix_tree_lm, np.random.default_rng(0)
    for v in (r.integers(-(1 << 63), 1 << 63 - 1, 50), np.zeros(0, np.int64), np.array([5], np.uint32)):
        raw = pa.array([m._planes(v)], pa.binary())[0]
        assert (m._unplanes(raw, v.dtype.type) == v).all()


def test_html_words_of_the_article_stay():
    """No single heading or phrase settles what lies in the article itself."""
    p = "A sentence of plain prose that goes on for a while, with a clause in it. " * 2
    kept = lambda page: html_text.main_text(page).split("\n")
    assert kept(f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{p}</p><p>All rights reserved.</p></article><footer><p>All rights reserved.</p></footer>") == ["T", p.strip(), "All rights reserved."]
    assert kept(f"<article><h2>Comments</h2><p>{p}</p></article>") == ["Comments", p.strip()]
    assert kept(f"<article><p>{p}</p><h2>Responses</h2><p>{p}</p></article>") == [p.strip(), "Responses", p.strip()]
    assert kept(f"<article><p>We use cookies in our kitchen to teach</p><p>{p}</p></article>")[0].startswith("We use cookies")
    assert kept(f"<article><p>{p}</p><div><p>We use cookies on these pages. {p}</p></div></article>") == [p.strip()]


def test_html_tree_asks_for_neighbours():
    def asked(tree):
        return set() if tree.split is None else {html_text.FEATURES[tree.split[0]]} | asked(tree.split[2]) | asked(tree.split[3])

    assert asked(html_text.default_tree()) & {"words before", "words after", "link density before", "link density after"}


def test_html_raw_tags_without_an_end_take_linear_time():
    import time

    began = time.time()
    assert html_text.main_text("<svg>" * 200_000 + "x" * 50) is not None  # a megabyte
    assert time.time() - began < 5


def plain_scores(rows):
    """Scores of the suffix tree over dicts."""
    m = suffix_tree_lm
    seqs = [[*m.tokens(t), m.END] for _, t in rows]
    train = [s for s, (i, _) in zip(seqs, rows, strict=True) if i is not None and zlib.crc32(str(i).encode()) % 10]
    words = Counter(w for s in train for w in s)
    divisor = words.total() + 0.1 * (len(words) + 1)
    prob = [lambda c, w: (words[w] + 0.1) / divisor]
    for d in range(1, m.DEPTH + 1):
        totals = Counter(tuple(s[k : k + d]) for s in train for k in range(len(s) - d))
        follow = {}
        for s in train:
            for k in range(len(s) - d):
                follow.setdefault(tuple(s[k : k + d]), Counter())[s[k + d]] += 1
        states = {}
        for c, n in follow.items():
            n = {w: x for w, x in n.items() if x >= m.LEAST}
            if n:
                p = {w: x / (totals[c] + len(n)) for w, x in n.items()}
                parent = {w: prob[-1](c[1:], w) for w in n}
                rest = max(1 - sum(p.values()), 1e-9) / max(1 - sum(parent.values()), 1e-9)
                gain = sum(x * math.log(p[w] / parent[w]) for w, x in n.items()) + (totals[c] - sum(n.values())) * math.log(rest)
                if gain > m.PER_SYMBOL * (len(n) + 1):
                    states[c] = p, rest
        prob.append(lambda c, w, states=states, d=d, shorter=prob[-1]: shorter(c[1:] if len(c) == d else c, w) if len(c) < d or c not in states else states[c][0].get(w) or states[c][1] * shorter(c[1:], w))
    return [sum(math.log10(prob[-1](tuple(s[max(0, k - m.DEPTH) : k]), w)) for k, w in enumerate(s)) for s in seqs]


def test_language_model_knows_repeats_at_any_size(spark, rows):
    """A passage of seldom words that occurs a few times among very many tokens is known, as on a small table."""
    r = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(40))
    fill = " ".join(r.choice("ab cd ef gh ij kl".split()) for _ in range(100_000))
    docs = [*((i, t) for i, t in rows), (200, fill), *((300 + k, passage) for k in range(6))]
    got = sorted((r.doc_id or -1, r.n_tokens, round(r.score, 3)) for r in suffix_tree_lm.score_documents(table(spark, docs)).collect())
    want = sorted((i or -1, len(suffix_tree_lm.tokens(t)) + 1, round(s, 3)) for (i, t), s in zip(docs, plain_scores(docs), strict=True))
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-6, atol=2e-3)
    assert all(x[2] > -40 for x in got if x[0] >= 300)


def plain_components(rows):
    sets = [frozenset(ngram_join.shingles(t).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and label[a] != label[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                    label = [label[b] if x == label[a] else x for x in label]
                    changed = True
    least = {x: min((i for (i, _), y in zip(rows, label, strict=True) if y == x and i is not None), default=None) for x in set(label)}
    return sorted((str(i), len(s), str(i if not s else least[x])) for (i, _), s, x in zip(rows, sets, label, strict=True))


def test_ngram_join(spark, rows, monkeypatch):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.components(table(spark, rows)).collect())
    assert got == plain_components(rows)
    # few nodes make an n-gram large: pivots and open pairs give the same
    r = random.Random(9)
    base = [str(r.random()) for _ in range(60)]
    family = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = f"m{i}"
        family.append((i, " ".join(w)))
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in ngram_join.components(table(spark, family)).collect())
    assert got == plain_components(family)


def test_links_through_rows_without_id(spark):
    """A set that only null ids have still joins others; rows of null ids alone have no component."""
    w = [f"w{k}" for k in range(60)]
    docs = [(1, " ".join(w)), (None, " ".join(["x", *w[1:], "a", "b"])), (2, " ".join(["y", *w[2:], "a", "b", "c"])), (None, "alone here with these five words"), (3, " ".join(w))]
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in ngram_join.components(table(spark, docs)).collect())
    assert got == plain_components(docs) and ("None", 2, "None") in got


def test_ngram_join_counts_small_and_large(spark, monkeypatch):
    """Pairs at the bound whose common n-grams are partly those of a large group, partly their own, in mixed order."""
    monkeypatch.setattr(ngram_join, "HOT", 10**9)
    passage = " ".join(f"s{k}" for k in range(45))
    own = lambda i, n: " ".join(f"{i}x{k}" for k in range(n))
    docs = [(i, f"{own(i, 14)} {passage} {own(f'pair{i // 2}', 45)}") for i in range(400)]
    got = {x.doc_id: x.component_id for x in ngram_join.components(table(spark, docs)).collect()}
    assert got == {i: i - i % 2 for i in range(400)}


def test_line_dedup(spark):
    r = random.Random(4)
    line = lambda n: " ".join(f"w{r.randrange(1000)}" for _ in range(n))
    a, b, short = line(30), line(12), "just two"
    changed, added, twice = a.replace(a.split()[9], "zz"), b + " end", " ".join(["q1", *a.split()[1:-1], "q2"])
    rows = [(1, f"{a}\n{short}\n{b}"), (2, f"{changed}\n{short}"), (3, f"{added}\n{twice}\n{line(8)}"), (4, a), (5, None), (6, ""), (7, a + "\n" + a)]
    got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup(table(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == (short, 1) and got[3][0].startswith(twice) and got[3][1] == 1
    assert got[4] == ("", 1) and got[5] == (None, 0) and got[6] == ("", 0) and got[7] == ("", 2)


def test_line_dedup_of_rows_that_share_an_id(spark):
    """Rows under one doc_id, or none, keep their own unique lines and lose repeats at the same place."""
    line = lambda k: " ".join(f"{k}w{j}" for j in range(12))
    for i in (None, 7):
        rows = [(i, f"{line('a')}\n{line('b')}"), (i, f"{line('c')}\n{line('d')}"), (i, f"{line('e')}\n{line('b')}"), (9, line("a"))]
        left = [x for r in line_dedup.dedup(table(spark, rows)).collect() for x in r.text.split("\n") if x]
        assert sorted(left) == sorted(line(k) for k in "abcde")


def test_decontamination(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    item = [r.choice(words) for _ in range(35)]
    edited = [("new" if k % 6 == 3 else w) for k, w in enumerate(item)]
    fill = lambda n: [r.choice(words) for _ in range(n)]
    docs = [(1, " ".join(fill(50) + item + fill(50))), (2, " ".join(fill(20) + edited + fill(9))), (3, " ".join(fill(200))), (4, None), (5, ""), (6, " ".join(item[:8] + fill(40)))]
    tests = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, None), (9, ""), (10, "too few words")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.find(table(spark, docs), tests).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7] == 1.0 and got[2, 7] < 0.9


def test_decontamination_among_many_copies(spark):
    """Edited copies are found however many copies of the item there are, wherever the edits lie."""
    r = random.Random(6)
    items = [[f"v{k}n{i}" for k in range(n)] for i, n in enumerate((20, 36, 58))]
    docs, n = [], 0
    for item in items:
        half = len(item) // 2
        copies = [[*item] for _ in range(60)]
        copies += [[f"e{k}" if k % 3 == at and (k < half) == first else w for k, w in enumerate(item)] for first in (True, False) for at in range(3)]
        for c in [*copies, item[half - 1 :], item[: half + 1], item[half + 5 :]]:
            docs.append((n, " ".join([*(f"f{r.randrange(99)}" for _ in range(9)), *c, "end"])))
            n += 1
    tests = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    plain = decontaminate.Items([(i, " ".join(x)) for i, x in enumerate(items)])
    want = set()
    for i, t in docs:
        seq = np.array([plain.number.get(w, 0) for w in decontaminate.words(t)], np.int64)
        want |= {(i, item) for item, w in plain.items if decontaminate.align(w, seq)[0] >= decontaminate.SIMILAR}
    assert {(x.doc_id, x.item_id) for x in decontaminate.find(table(spark, docs), tests).collect()} == want


def test_decontamination_is_the_same_in_blocks(spark, monkeypatch):
    """Repeated and null ids, short items, clashing columns: one block of items or many give the same rows."""
    items = [f"it{i}a it{i}b it{i}c it{i}d" + "".join(f" it{i}x{k}" for k in range(i)) for i in range(6)] + ["uno", "duo dua"]
    docs = [(7, f"here {items[0]} end"), (7, f"here {items[3]} end"), (7, f"here {items[0]} end"), (None, f"{items[5]} and {items[4]}"), (None, "nothing"), (3, "it0a it0b it0d"), (4, "say uno now"), (5, "duo dua"), (6, "dua duo")]
    tests = spark.createDataFrame([*enumerate(items), (2, "second text of it"), (None, "it0a it0b it0c")], "item_id long, text string")
    find = lambda: sorted((str(r.doc_id), r.item_id, round(r.score, 6)) for r in decontaminate.find(table(spark, docs), tests).collect())
    one = find()
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    assert find() == one and [x[:2] for x in one] == [("4", 6), ("5", 7), ("7", 0), ("7", 0), ("7", 3), ("None", 4), ("None", 5)]
    assert decontaminate.find(table(spark, []), tests).count() == 0


def test_recall_of_edited_items(spark):
    """Items with words replaced at random: nearly all that score high enough by full alignment are found."""
    r = random.Random(11)
    items = [[f"i{i}w{r.randrange(60)}" for _ in range(30)] for i in range(12)]
    docs, want = [], set()
    plain = decontaminate.Items([(i, " ".join(x)) for i, x in enumerate(items)])
    for share in (0.1, 0.2, 0.3, 0.4):
        for i, item in enumerate(items):
            for _ in range(4):
                copy = [f"e{r.randrange(999)}" if r.random() < share else w for w in item]
                seq = np.array([plain.number.get(w.encode(), 0) for w in copy], np.int64)
                if decontaminate.align(plain.items[i][1], seq)[0] >= decontaminate.SIMILAR:
                    want.add((len(docs), i))
                docs.append((len(docs), " ".join(["f1 f2", *copy, "f3"])))
    tests = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find(table(spark, docs), tests).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 120


def test_toxicity(spark):
    r = random.Random(8)
    fill = lambda n: [r.choice("ab cd ef gh ij kl mn op".split()) for _ in range(n)]
    docs, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        w = fill(20)
        if toxic:
            w.insert(r.randrange(20), "grumble"), w.insert(r.randrange(20), "snarlers")
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    extra = [(1000, "ab grumblle cd snarlrs ef"), (1001, 'ab cd said "grumble" ef gh'), (1002, None), (1003, ""), (1004, "ab cd")]
    got = {x.doc_id: x for x in toxicity.score_documents(table(spark, docs + extra), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(300))
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1002].score == got[1004].score < 0.5
    none = toxicity.score_documents(table(spark, extra), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {x.score for x in none.collect()} == {0.0}


def test_levenshtein_walk():
    trie = toxicity.Trie((), (), ("grumble",))
    for w, near in (("grumble", True), ("grumbl", True), ("rumble", True), ("grumbles", True), ("grxmble", True), ("grxxble", False), ("grmubles", False), ("xgrumble", True)):
        assert trie.near(w) == near, w


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_walk_against_edit_distance():
    r = random.Random(6)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(toxicity.FUZZY_FROM - 1, 8)))
    found = 0
    for _ in range(300):
        terms = [w for w in (word() for _ in range(r.randint(1, 6))) if len(w) >= toxicity.FUZZY_FROM]
        trie = toxicity.Trie((), (), terms)
        for w in (word() for _ in range(10)):
            want = any(edit_distance(w, t) <= 1 for t in terms)
            assert trie.near(w) == want, (w, terms)
            found += want
    assert 100 < found < 2900


def test_quality_counts_against_plain_loops():
    r = random.Random(9)
    for _ in range(300):
        text = "".join(r.choice(["a", "b", "# ", "*", "$%", "&|", "<>", " ", " ", "\n", "\n", "\t", "\x0b", "é", "日 ", "\x85", "!"]) for _ in range(r.randint(0, 120)))
        words, at = [], ""
        for c in text + " ":
            if c in " \t\n\x0b\x0c\r":
                words += [at] * bool(at)
                at = ""
            else:
                at += c
        seen, again = set(), 0
        for line in text.split("\n"):
            if any(c not in " \t\n\x0b\x0c\r" for c in line):
                again += line in seen
                seen.add(line)
        windows = [words[k : k + 3] for k in range(len(words) - 2)]
        inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        assert quality.measure(text)[:5] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside))
    assert quality.measure(None) == (0,) * 8


def test_quality(spark, rows):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.n_words): r for r in quality.verdicts(table(spark, rows), labels).collect()}
    for i, t in rows:
        words = quality.WORD.findall(t or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        seen = Counter(windows)
        repeat = len({k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)})
        g = got[i, len(words)]
        assert (g.word_chars, g.n_repeat_words) == (sum(map(len, words)), repeat)
        assert g.base_failed == (len(words) < 50 or 100 * repeat > 50 * len(words)) and g.kept == (not g.base_failed)
    assert quality.certified(0, 5000, 0.01, 1e-4) and not quality.certified(0, 100, 0.01, 1e-4) and not quality.certified(60, 5000, 0.01, 1e-4)


def test_quality_cutoffs_hold_their_bound(spark):
    """Certified steps against bounds summed term by term; small languages are pooled, one without labels is left alone."""
    r = random.Random(4)
    docs, labels = [], []
    for i in range(4000):
        lang, bad = ("en" if i % 4 else ("de", "fr")[i // 4 % 2]), i % 5 == 0
        w = [r.choice("ab cd ef gh ij kl mn op qr st".split()) + str(r.randrange(99)) for _ in range(60)]
        if bad or i % 333 == 1:
            w = [x + "###" if r.random() < (0.5 if i % 3 else 0.05) else x for x in w]
        docs.append((i, " ".join(w), lang))
        labels.append((i, int(not bad), 0))
    docs += [(5000, docs[0][1], "it"), (5001, docs[0][1], None), (5002, docs[2][1], "en")]
    table_ = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = quality.judge(table_, spark.createDataFrame(labels + labels[:9], "doc_id long, quality int, toxic int")).collect()
    kept, failed = {x.doc_id: x.kept for x in found}, {x.doc_id for x in found if x.base_failed}
    path, held = quality.cutoffs(quality.measures(table_).withColumn("base_failed", quality.F.lit(False)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(held) == {"en", "de", "fr"} and held["en"] > 0 and held["de"] == held["fr"] and path[0][0] == "symbols"
    hold = [i for i, y, _ in labels if y and zlib.crc32(str(i).encode()) % 10 >= quality.FIT and i not in failed]
    for group in (["en"], ["de", "fr"]):
        good = [i for i in hold if docs[i][2] in group]
        lost = sum(not kept[i] for i in good)
        bound = sum(math.comb(len(good), k) * quality.ALPHA**k * (1 - quality.ALPHA) ** (len(good) - k) for k in range(lost + 1))
        assert (bound <= quality.DELTA / 2) == (held[group[0]] > 0) or lost == 0
        if held[group[0]]:
            assert bound <= quality.DELTA / 2
    rejected = [i for i, y, _ in labels if not y and docs[i][2] == "en" and not kept[i]]
    assert len(rejected) > 300 and kept[5000] and kept[5001] and kept[5002]
    assert quality.steps_certified([0, 1, 900, 0], 1000, 0.025) == 2 and quality.steps_certified([0], 100, 0.025) == 0


def test_html(spark):
    page = "<html><head><title>no</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class=ad>Buy now.</div><article><h1>A &amp; B</h1><p><b>One\n two<br>three<p>Four.</p><div class=comments><p>Nice text, thank you for it.</p></div></article><footer>&copy; me</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", page[:200])]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("A & B\nOne two three\nFour.", 25) and got[2] == ("", 0) == got[3]


PROSE = "Plain words of an article stand here, one after the other, until there are enough of them to be read."
SIDE = "Other words that do not belong to it stand here, as many of them as in any other place of the page."
LAYOUTS = {
    "furniture within": f"<article><nav><a href=a>Prev page</a> <a href=b>Next page</a></nav><h1>Head</h1><p>{PROSE}</p><aside>{SIDE}</aside><form>Your mail <button>Send it</button></form><p>Bye.</p><footer>Posted by x in y</footer></article>",
    "telling names of the article": f"<article class='post header-large tag-news'><h1>Head</h1><p>{PROSE}</p><p>Bye.</p></article><div class=tags><a href=t>t</a></div>",
    "telling names of the body": f"<body class='with-sidebar cookie-accepted'><div id=nav-main><a href=a>Home</a></div><main><h1>Head</h1><p>{PROSE}</p><p>Bye.</p></main><div id=sidebar><p>{SIDE}</p></div>",
    "no article": f"<body><ul><li><a href=a>A story of today</a><li><a href=b>A story of yesterday</a></ul><h1>Head</h1><p>{PROSE}</p><p>Bye.</p><section class=comments><p>{SIDE}</p></section>",
    "advert and replies without names": f"<article><h1>Head</h1><p>{PROSE}</p><div><p>Advertisement</p><p>{SIDE}</p></div><p>Bye.</p><section><h3>3 comments</h3><p>{SIDE}</p><p>Nice</p></section></article>",
    "raw elements": f"<body><svg width=3 /><math/><article><h1>Head</h1><select><option>a<p>{PROSE}</p><object><p>Bye.</p><script>if (a < b) '</p>'</script></article>",
    "notice": f"<body><div><p>We use cookies. {SIDE}</p></div><article><h1>Head</h1><p>{PROSE}</p><p>Bye.</p></article><p>&copy; 2020 the site</p>",
}


def test_html_layouts(spark):
    """Layouts that are not in the labelled table, with the exact text; a repeated, an empty and a very long page; clashing columns."""
    long_page = f"<article>{f'<p>{PROSE}</p>' * 5000}</article>"
    rows = [*((k, "u", page, "x") for k, page in enumerate(LAYOUTS.values())), (90, "u", long_page, "x"), (0, "u", LAYOUTS["furniture within"], "x"), (None, None, None, None)]
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()]
    want = f"Head\n{PROSE}\nBye."
    assert [g[2] for g in got[: len(LAYOUTS)]] == [want] * len(LAYOUTS), [k for k, g in zip(LAYOUTS, got, strict=False) if g[2] != want]
    assert got[-3][2] == "\n".join([PROSE] * 5000) and got[-2] == (0, "u", want, len(want)) and got[-1] == (None, None, "", 0)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_tree_uses_the_features_of_the_method():
    used, stack = set(), [html_text.default_tree()]
    while stack:
        t = stack.pop()
        if t.split:
            used.add(html_text.FEATURES[t.split[0]])
            stack += t.split[2:]
    assert {"words", "link density", "furniture"} <= used


def test_empty_tables(spark):
    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    tests = spark.createDataFrame([], "item_id long, text string")
    for df in (bpe.digests(none, PATH), section_tokens.count_by_section(none, PATH), wavelet.token_table(none, PATH), suffix_tree_lm.score_documents(none), ngram_join.components(none), line_dedup.dedup(none), decontaminate.find(none, tests), toxicity.score_documents(none, labels), quality.verdicts(none, labels)):
        assert df.collect() == []
