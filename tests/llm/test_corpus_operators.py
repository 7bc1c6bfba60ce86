"""Each operator against a brute-force version, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import prose, table, words

from siltstone.llm import decontamination, language_id, mixing, near_dup, quality_fm, quality_rules, sharding, substring_dedup, token_store, toxicity
from siltstone.llm.shared import documents, tokenizer_path


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- 1: token store ----------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def tokens(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check_store(docs, tokenizer):
    store = token_store.TokenStore.write(docs, tokenizer_path())
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in store.documents().collect())
    rows = docs.select("doc_id", "text").collect()
    want = collections.Counter((r["doc_id"], len(t := tokens(tokenizer, r["text"])), zlib.crc32(np.array(t, "<u4").tobytes())) for r in rows)
    assert collections.Counter((d, n, c) for _, d, n, c in got) == want
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    order = [d for _, d, _, _ in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    back = {r["start"]: r["ids"] for r in store.reconstruct().collect()}
    assert all(zlib.crc32(np.array(back[s], "<u4").tobytes()) == c for s, _, _, c in got)
    return store


def test_store_round_trip(spark, sf_dir, tokenizer):
    check_store(documents(spark, sf_dir), tokenizer)


def test_store_odd(clashing, empty, tokenizer):
    store = check_store(clashing, tokenizer)
    keys = [r["key"] for r in store._kind(0).collect()]
    assert len(keys) == len(set(keys))
    assert token_store.TokenStore.write(empty, tokenizer_path()).documents().collect() == []


def test_store_stores_copies_once(spark, tokenizer):
    store = token_store.TokenStore.write(table(spark, [prose(4, 3000)] * 20), tokenizer_path())
    stored = sum(r["n"] for r in store._kind(0).collect())
    assert stored == len(tokens(tokenizer, prose(4, 3000)))


def test_store_finds_damage(spark):
    store = token_store.TokenStore.write(table(spark, [prose(1, 200)]), tokenizer_path())
    chunk = store._kind(0).collect()[0]
    body = bytearray(chunk["body"])
    body[0] ^= 1
    batch = pa.RecordBatch.from_arrays([pa.array([bytes(chunk["key"])], pa.binary()), pa.array([chunk["n"]], pa.int64()), pa.array([bytes(body)], pa.binary())], names=["key", "n", "body"])
    with pytest.raises(ValueError, match="damaged"):
        list(token_store._crc_chunks(iter([batch])))


@pytest.mark.parametrize("text", ["it's we'll 'sa x's,y", "a.b,c!!d 1a2", "»,a é, É!", "é, Á", "<|endoftext|> x<|b", "\x01 a\x01b", "KK İi", "a_b-c'd", " x y"])
def test_pieces_equal_whole(tokenizer, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, _ = token_store.PieceEncoder(tokenizer_path()).encode(raw, np.array([0, len(raw)]))
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_crc_of_both():
    a, b = b"abc" * 50, b"defg" * 33
    assert token_store.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# --- 2: sharding -------------------------------------------------------------


def check_shards(docs):
    rows = sharding.shard(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in texts)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots, where, total = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"], r["size"]].add(r["shard"])
        total[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values()) and all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    return total


def test_shards_are_near_equal(spark):
    total = check_shards(table(spark, [prose(k, 20 + k % 70) for k in range(900)]))
    assert len(total) == 24 and max(total.values()) - min(total.values()) <= 8


def test_shards_odd(clashing, empty):
    check_shards(clashing)
    assert sharding.shard(empty).collect() == []


def test_differencing_beats_dealing():
    sizes = [8, 7, 6, 5, 4]
    place, sums = sharding.differenced([np.array([0, s]) for s in sizes])
    got = collections.Counter()
    for p, s in zip(place[:, -1], sizes, strict=True):
        got[p] += s
    assert sorted(got.values()) == sorted(sums - sums.min() + min(got.values()))
    assert max(got.values()) - min(got.values()) <= 2


# --- 3: quality rules --------------------------------------------------------


def measured(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics(spark, sf_dir, clashing):
    for docs in (documents(spark, sf_dir), clashing):
        want = collections.Counter((r["doc_id"], *measured(r["text"])) for r in docs.select("doc_id", "text").collect())
        rows = quality_rules.judge(docs).collect()
        assert collections.Counter((r["doc_id"], *(r[c] for c in quality_rules.BASE)) for r in rows) == want
        assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and r["kept"] == (not r["base_failed"]) for r in rows)


def test_rules_are_learned(spark):
    good = [prose(k, 60) for k in range(150)]
    bad = [" ".join(w + "###" for w in prose(k, 60).split()) for k in range(50)]
    docs = table(spark, good + bad)
    rules = quality_rules.learn(docs, labels(spark, [(i, int(i < 150), 0) for i in range(200)]))
    assert rules and rules[0][0].measure in ("symbols", "mean_word")
    kept = {r["doc_id"] for r in quality_rules.judge(docs, rules=rules).collect() if r["kept"]}
    assert kept == set(range(150))


def test_rules_plan_is_native(spark, sf_dir):
    plan = quality_rules.judge(documents(spark, sf_dir), rules=[])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rules_empty(spark, empty, clashing):
    assert quality_rules.judge(empty, labels(spark, [])).collect() == []
    assert quality_rules.learn(clashing, labels(spark, [(None, 1, 0), (3, None, 0)])) == []


# --- 4: decontamination ------------------------------------------------------


def trigrams(text):
    w = re.findall("[a-z0-9\\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)}


@pytest.mark.parametrize("parts", [8, 40])
def test_hits_do_not_depend_on_parts(spark, monkeypatch, parts):
    texts = [prose(k, 15 + k % 40, 120) for k in range(160)]
    docs = table(spark, [f"{prose(500 + k, 60)} {' '.join(t.split()[: len(t.split()) * (6 + k % 5) // 10])} {prose(900 + k, 60)}" for k, t in enumerate(texts)])
    whole = sorted(decontamination.leaks(docs, items(spark, texts)).collect())
    assert len(whole) > 80
    monkeypatch.setattr(decontamination, "ITEMS_PER_PART", 160 // parts)
    assert sorted(decontamination.leaks(docs, items(spark, texts)).collect()) == whole
    assert {r["doc_id"] for r in decontamination.clean(docs, items(spark, texts)).collect()} == set(range(160)) - {r["doc_id"] for r in whole}


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_leaks(spark, sf_dir):
    docs, bench = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts, wanted = {r["doc_id"]: r["text"] or "" for r in docs.collect()}, {r["item_id"]: r["text"] for r in bench.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in wanted.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()}
    assert want <= got
    # what else is found shares most of its trigrams with the item
    for d, i in got - want:
        have, grams = trigrams(texts[d]), trigrams(wanted[i])
        assert len(have & grams) >= 0.5 * len(grams)
    assert decontamination.clean(docs, bench).count() == docs.count() - len({d for d, _ in got})


def test_wand_returns_all_above_threshold():
    index = decontamination.Index([(k, prose(k, 12 + k % 25, 60)) for k in range(120)])
    impact = np.zeros((len(index.vocabulary), 120))
    for t, (docs, weights) in enumerate(index.postings):
        impact[t, docs] = weights
    rng = np.random.default_rng(0)
    for _ in range(60):
        terms = rng.choice(len(index.vocabulary), rng.integers(1, 40), replace=False)
        score = impact[terms].sum(axis=0)
        for threshold in (0.3, 0.5, 0.8):
            assert sorted(i for i, _ in index.search(terms.tolist(), threshold)) == np.flatnonzero(score >= threshold - 1e-9).tolist()


@pytest.mark.parametrize("n", [20, 65, 200, 250, 300, 600, 2000])
def test_long_items_at_any_offset(spark, n):
    offsets = [0, 1, 37, 63, 64, 100, 999, 3000]
    item, other = " ".join(f"t{k}" for k in range(n)), prose(3, 40)
    docs = table(spark, [f"{prose(70 + o, o)} {item} {prose(90 + o, 500)}" for o in offsets] + [prose(7, 6000)])
    got = decontamination.leaks(docs, items(spark, [item, other])).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, 0) for i in range(len(offsets))}
    assert all(r["question_overlap"] == r["answer_overlap"] == 1 for r in got)


def test_leaks_odd(spark, clashing, empty):
    bench = items(spark, [prose(1, 40), None, "", "one", prose(1, 40)])
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(clashing, bench).collect()}
    assert {(5, 0), (6, 0), (7, 0), (None, 0), (5, 4)} <= got and not {d for d, _ in got} & {0, 1, 2, 9, 13}
    assert decontamination.leaks(empty, bench).collect() == [] and decontamination.leaks(clashing, items(spark, [None]).where("false")).collect() == []
    assert decontamination.clean(clashing, bench).columns == clashing.columns


# --- 5: mixing ---------------------------------------------------------------


def test_targets():
    t = mixing.targets({"a": 100, "b": 100, "c": 10, None: 90})
    assert t["c"] == 30 and sum(t.values()) == pytest.approx(300) and t["b"] == pytest.approx(2 * t["a"]) and t[None] == pytest.approx(t["a"])
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_fit_is_exact_where_possible():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 300, 20))
        counts = rng.integers(1, 40, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fitted(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and 0 <= budget - (take * lengths).sum() <= 2


def test_mix(spark, sf_dir, clashing, empty):
    docs = documents(spark, sf_dir)
    rows = mixing.mix(docs).collect()
    source = {d["doc_id"]: d["source"] for d in docs.collect()}
    taken, goal = collections.Counter(), {}
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        goal[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    assert sum(abs(taken[s] - goal[s]) for s in goal) <= 0.01 * sum(goal.values())
    assert sorted(mixing.mix(docs.repartition(7)).collect()) == sorted(rows)
    assert mixing.mix(clashing).count() == clashing.count() and mixing.mix(empty).collect() == []
    assert mixing.mixed(clashing).columns == clashing.columns
    assert mixing.mixed(docs).count() == sum(r["taken"] // r["size"] for r in rows if r["size"])


# --- 6: near duplicates ------------------------------------------------------


def sets_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(docs):
    found = {}
    rows = [(r["doc_id"], sets_of(r["text"])) for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    for d, x in rows:
        found.setdefault(d, set()).add((len(x), root(d)))
    return found


def edited(text, share, seed):
    import random

    rng = random.Random(seed)
    return " ".join(f"x{seed}y{k}" if rng.random() < share else w for k, w in enumerate(text.split()))


@pytest.mark.parametrize("which", ["testdata", "odd", "copies"])
def test_near_duplicates(spark, sf_dir, clashing, which):
    base = prose(5, 300)
    docs = {"testdata": lambda: documents(spark, sf_dir), "odd": lambda: clashing, "copies": lambda: table(spark, [edited(base, 0.002 * (k % 20), k) for k in range(200)] + [prose(50 + k, 80) for k in range(40)])}[which]()
    want = groups(docs)
    for r in near_dup.near_duplicates(docs).collect():
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) in want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])


@pytest.mark.parametrize("n_pairs", [20, 60])
def test_near_duplicates_over_boilerplate(spark, n_pairs):
    """All texts share 296 of 346 shingles (0.747); the two of a pair share one more (0.752), so they meet in hot buckets only."""
    base = " ".join(f"b{k}" for k in range(300))
    docs = table(spark, [f"{base} p{i // 2} " + " ".join(f"u{i}x{k}" for k in range(49)) for i in range(2 * n_pairs)])
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: i - i % 2 for i in range(2 * n_pairs)}


@pytest.mark.parametrize("n_changed", [5, 6, 7])
def test_near_duplicates_of_one_form(spark, n_changed, monkeypatch):
    """One form with some words changed in each: links are few and hidden among many pairs just under the threshold."""
    if n_changed == 6:
        monkeypatch.setattr(near_dup, "BLOCK", 100)  # buckets are dealt by class and block
    rng = np.random.default_rng(n_changed)
    form = [f"f{k}" for k in range(300)]
    texts = []
    for i in range(500):
        at = set(rng.choice(300, n_changed, replace=False).tolist())
        texts.append(" ".join(f"c{i}x{k}" if k in at else w for k, w in enumerate(form)))
    docs = table(spark, texts)
    want = groups(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs).collect()}
    assert all({got[d]} == want[d] for d in want)


def test_cells_find_what_all_pairs_do():
    """Cut into batches anywhere, cells give the pairs of two components, two blocks and agreeing signatures."""
    rng = np.random.default_rng(5)
    n = 400
    forms = rng.integers(0, 1 << 16, (12, near_dup.BINS)).astype(np.uint16)
    bins = forms[rng.integers(0, 12, n)]
    bins[rng.random(bins.shape) < 0.3] = 7
    bins[:, :4] = 1
    cell, block, component, size = np.sort(rng.integers(0, 9, n)), rng.integers(0, 2, n), rng.integers(0, 30, n), rng.integers(60, 100, n)
    columns = {"cell": cell, "block": block, "lower": np.zeros(n, bool), "band": np.zeros(n, np.int8), "rep": np.arange(n), "component": component, "n": size, "bands": near_dup.kernel.list_array(bins.reshape(-1).view(np.int64), np.full(n, near_dup.BANDS))}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    def all_pairs(found):
        rep = found.table.column("rep").to_numpy()
        for a, b in found.pairs():
            yield pa.table({"a": rep[a], "b": rep[b]})

    got = [tuple(sorted(p)) for b in near_dup._in_cells(all_pairs)(batch.slice(k, 37) for k in range(0, n, 37)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = [(i, j) for i in range(n) for j in range(i + 1, n) if cell[i] == cell[j] and block[i] != block[j] and component[i] != component[j] and 100 * min(size[i], size[j]) >= 75 * max(size[i], size[j]) and (bins[i] == bins[j]).sum() >= near_dup.LEAST_BINS]
    assert want and sorted(got) == want
    some = pa.Table.from_batches(near_dup._in_cells(near_dup._Cell.promising)(iter([batch])))
    assert set(some.column("rep").to_pylist()) == {i for p in want for i in p}


def test_near_duplicates_of_nothing(empty):
    assert near_dup.near_duplicates(empty).collect() == []


# --- 7, 8, 9: learned scores -------------------------------------------------


def test_fm_identity():
    fm = quality_fm.FactorisationMachine()
    rng = np.random.default_rng(1)
    fm.v = rng.normal(0, 1, fm.v.shape)
    fm.w = rng.normal(0, 1, fm.w.shape)
    raw = np.frombuffer(b"some words here some", np.uint8)
    owner, bucket, value, structure = quality_fm.features(raw, np.array([0, len(raw)]), np.array([4.0]))
    index = np.concatenate([bucket, quality_fm.BUCKETS + np.arange(len(quality_fm.STRUCTURE))])
    x = np.concatenate([value, fm.standard(structure)[0]])
    margin = fm.bias + fm.w[index] @ x + sum(fm.v[index[i]] @ fm.v[index[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert fm.scores(raw, np.array([0, len(raw)]), np.array([4.0]))[0] == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def test_quality_on_held_out(spark, sf_dir, clashing, empty):
    lab = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    docs = documents(spark, sf_dir.replace("0.001", "0.01"))
    truth = {r["doc_id"]: r["quality"] for r in lab.collect()}
    rows = [r for r in quality_fm.score(docs, lab).collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(held(r["doc_id"], 5, 0) for r in rows) and np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) >= 0.95
    out = quality_fm.score(clashing, lab).collect()
    assert len(out) == clashing.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert quality_fm.score(empty, labels(spark, [])).collect() == []


def test_toxicity_on_held_out(spark, sf_dir, clashing, empty):
    big = sf_dir.replace("0.001", "0.01")
    lab, docs = spark.read.parquet(f"{big}/labels.parquet"), documents(spark, big)
    truth = {r["doc_id"]: r["toxic"] for r in lab.collect()}
    rows = [r for r in toxicity.score(docs, lab).collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(held(r["doc_id"], 3, 1) for r in rows)
    assert not [r for r in rows if r["predicted"] and not truth[r["doc_id"]]]
    assert np.mean([r["predicted"] for r in rows if truth[r["doc_id"]]]) >= 0.7
    out = toxicity.score(clashing, lab).collect()
    assert len(out) == clashing.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(empty, labels(spark, [])).collect() == []


def test_toxicity_folds_and_excuses():
    lexicon = toxicity.learn([], [])
    high = lexicon.scores(pa.array(["you 1d10t!", "an іdіot", "IDIOT", "trash", "the trash can", "idiotic", "an id iot", ""]))
    assert [x >= 0.7 for x in high] == [True, True, True, True, False, True, False, False]


def naive_score(lexicon, text):
    """A text's score by looking at each word for each stem and each exception."""
    folded, margin, found = [toxicity.fold(w) for w in words(text)], lexicon.bias, {}
    for i, w in enumerate(folded):
        stems = [s for s in lexicon.stems if w.startswith(s)]
        phrases = [e.split(" ") for e in lexicon.exceptions]
        excused = any(folded[k : k + len(p)] == p for p in phrases for k in range(max(0, i - len(p) + 1), i + 1))
        if stems and not excused:
            best = max(stems, key=lambda s: (lexicon.stems[s], s))
            found[best] = found.get(best, 0) + 1
    for s, c in found.items():
        margin += lexicon.stems[s] * 2 * c / (1 + c) / (1 + np.log1p(len(folded) / (500 * c)))
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def test_toxicity_equals_naive_search(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    lexicon = toxicity.train(documents(spark, big), spark.read.parquet(f"{big}/labels.parquet"))
    texts = [r["text"] for r in documents(spark, sf_dir).collect()]
    rng = random.Random(5)
    parts = [*lexicon.stems, *(w for e in lexicon.exceptions for w in e.split(" ")), "id1ot", "ab", "!!!", "\u0456diot"]
    texts += [None, "", *(" ".join(rng.choice(parts) + rng.choice(["", "s", "."]) for _ in range(rng.randint(1, 12))) for _ in range(300))]
    assert len(lexicon.stems) > 5 and lexicon.scores(pa.array(texts, pa.string())) == pytest.approx([naive_score(lexicon, t) for t in texts])


def test_equal_density_never_scores_lower():
    lexicon = toxicity.learn([], [])
    passage = " ".join(["calm"] * 49 + ["idiot"])
    scores = lexicon.scores(pa.array([" ".join([passage] * k) for k in (1, 2, 8, 9, 400, 4000)]))
    assert scores == sorted(scores) and scores[0] >= toxicity.THRESHOLD


def test_language(spark, sf_dir, clashing, empty):
    docs = documents(spark, sf_dir.replace("0.001", "0.01"))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language_id.identify(docs).collect()
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]) >= 0.98
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 for r in rows)
    odd = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(clashing).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (11, "und")} <= odd
    assert language_id.identify(empty).collect() == [] and language_id.accepted(clashing).columns == clashing.columns


def streamed(text):
    low = "".join(c.lower() if c < "\x80" or "\xc0" <= c <= "\xde" else c for c in text or "")
    return "".join(" " + w for w in re.findall("[a-z\x80-\U0010ffff]+", low)).encode()


def parsed(stream, known):
    """The phrases of a greedy parse into the longest strings that occur in ``known``."""
    n = i = 0
    while i < len(stream):
        k = 1
        while i + k < len(stream) and stream[i : i + k + 1] in known:
            k += 1
        i, n = i + k, n + 1
    return n


def test_automaton_parses_greedily():
    """Over streams shorter and longer than lanes, unknown letters, and copies of the learned text that cross lanes."""
    known = streamed(prose(1, 900, 80))
    automaton = language_id.Automaton(known)
    texts = [prose(2, 2000, 90), prose(1, 900, 80), "x", "", "  ,. ", "ż" * 900, prose(3, 700, 80) + " " + prose(1, 900, 80)[100:3000] + " " + prose(4, 700, 80), "é à " + prose(5, 60), "zzzz " * 400]
    raw = [t.encode() for t in texts]
    streams, first = language_id.letter_streams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [streams[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)] == [streamed(t) for t in texts]
    assert automaton.phrases(streams, first).tolist() == [parsed(streamed(t), known) for t in texts]


def test_languages_by_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = docs.where("text is not null").collect()
    known = {}
    for r in rows:
        known.setdefault(r["lang"], []).append(r["text"])
    known = {k: v[:3] for k, v in known.items() if k is not None}
    model = language_id.LanguageModel(known, 3000)
    trained = {k: b"".join(map(streamed, v))[:3000] for k, v in known.items()}
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    for r in [r for r in rows if len(r["text"]) < 4000][:60]:
        stream = streamed(r["text"])
        if stream:
            need = {k: parsed(stream, v) / len(stream) for k, v in trained.items()}
            assert got[r["doc_id"]] == min(sorted(need), key=need.get)


# --- 10: substring deduplication ---------------------------------------------


def removed(docs):
    rows = [(r["doc_id"], words(r["text"])) for r in docs.select("doc_id", "text").collect()]
    first = {}
    for d, w in rows:
        if d is not None:
            for i in range(len(w) - 12):
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, d), d)
    out = collections.Counter()
    for d, w in rows:
        gone = {j for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        out[d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substrings(spark, sf_dir, batches):
    docs = documents(spark, sf_dir)
    got = collections.Counter(tuple(r) for r in substring_dedup.deduplicate(docs, batches=batches, fanout=2).collect())
    assert got == removed(docs)


def test_substrings_odd(clashing, empty):
    assert collections.Counter(tuple(r) for r in substring_dedup.deduplicate(clashing).collect()) == removed(clashing)
    assert substring_dedup.deduplicate(empty).collect() == []


def test_common_line_leaves_a_task_once():
    """Of a window in many documents a map task indexes the first one's; the others are known as duplicates."""
    line = " ".join(f"l{k}" for k in range(13))
    texts = [f"{line} {prose(k, 20)}" for k in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(range(50), pa.int64()), pa.array(texts)], names=["doc_id", "row_key", "text"])
    rows = [(b.column(0)[0].as_py(), b.column(1)[0].as_py()) for b in substring_dedup._fingerprints(13, 4, 56, 8)(iter([batch]))]
    keys = np.concatenate([substring_dedup._decoded([p])[0] for b, p in rows if b >= 0])
    assert len(keys) == len(np.unique(keys)) == len({tuple(words(t)[i : i + 13]) for t in texts for i in range(len(words(t)) - 12)})
    late = [substring_dedup.unpack(p) for b, p in rows if b < 0]
    assert sorted(d for doc, _, n, pos in late for d, at in zip(np.repeat(doc, n), pos, strict=True) if at == 0) == list(range(1, 50))


def test_index_is_deleted(spark, sf_dir):
    import os

    before = set(spark.catalog.listTables()), set(os.listdir(substring_dedup.shared_path(spark, "x").rsplit("/", 1)[0]))
    substring_dedup.deduplicate(documents(spark, sf_dir))
    after = os.listdir(substring_dedup.shared_path(spark, "x").rsplit("/", 1)[0])
    assert set(spark.catalog.listTables()) == before[0] and not [x for x in set(after) - before[1] if x.startswith("fingerprints")]


def test_byte_planes_round_trip():
    columns = [np.array([], np.uint64), np.array([1, 1 << 60], np.uint64), np.arange(300, dtype=np.uint16), np.array([-5, 9], np.int64)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, substring_dedup.unpack(substring_dedup.pack(*columns)), strict=True))
