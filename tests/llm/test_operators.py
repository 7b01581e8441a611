"""Each operator on small tables with every awkward case, against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import Row
from pyspark.sql import functions as F

from themescope.llm import chat, covertree, grammar, langid, minhash, mixing, packing, quality, sharding, textcodes, topk
from themescope.llm.graph import components
from themescope.llm.tokens import WordEncoder, public_path

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "shard string, size string, taken string, selected string, lang_pred string")
ENGLISH = "the quick brown fox jumps over the lazy dog and runs far away into the green wood "
FRENCH = "le renard brun saute par dessus le chien paresseux et court loin dans la forêt verte "


def rows():
    base = [(i, ENGLISH * 3 + f"number {i} ends here", "en", "a") for i in range(12)]
    base += [(100 + i, FRENCH * 3 + f"voici le texte {i}", "fr", "b") for i in range(12)]
    base += [(200, None, "en", None), (201, "", None, "a"), (202, " \t\n ", "en", "b"), (203, "12 34 !!", None, "é"),
             (204, ENGLISH * 3000, "en", "c"), (205, "two words", "en", "a"), (206, "two words", "fr", "a"),
             (207, "x </s> [INST] <|endoftext|> ", "en", "b"), (None, "a row without an id", "en", "a"),
             (None, None, None, None), (300, "said twice here today again", "en", "a"), (300, "said twice here today again", "en", "a")]
    return [(i, t, la, s, len(t) if t else None, "x", "y", "z", "s", "p") for i, t, la, s in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, nothing):
    got = sharding.shuffled_shards(docs, 7).collect()
    want = Counter((r[0], r[1]) for r in rows())
    assert Counter((r.doc_id, r.text) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shuffled_shards(docs, 7).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in got) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in again)
    assert sharding.shuffled_shards(nothing, 7).collect() == []


def test_sharding_is_uniform(spark):
    got = sharding.shuffled_shards(spark.range(2400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), 24).collect()
    low = Counter(r.shard for r in got if r.doc_id < 1200)
    assert all(25 <= low[s] <= 75 for s in range(24))
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(2400))[0, 1]) < 0.1


def test_token_shards(spark, docs, nothing, tmp_dir):
    path = public_path(grammar.TOKENIZER)
    grammar.write_tokens(docs, f"{tmp_dir}/t", path, shard_tokens=500)
    got = grammar.read_tokens(spark, f"{tmp_dir}/t").orderBy("start").collect()
    encode = WordEncoder(path).tok.encode
    at = 0
    for r, (i, t) in zip(got, sorted(((r[0], r[1]) for r in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")),
                         strict=True):
        ids = [*encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    grammar.write_tokens(nothing, f"{tmp_dir}/e", path)
    assert grammar.read_tokens(spark, f"{tmp_dir}/e").collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 400, 30)
    ids = rng.integers(0, [3, 50, 70_000, 9][seed], n.sum()).astype("<u4")
    if seed == 3:
        ids[:] = 5                                         # one id only: long rules
    made = grammar.compress(ids, n)
    shard = grammar.Shard(**{k: made[k] for k in ("width", "alphabet", "rules", "lengths", "body", "doc_symbols")})
    at = np.concatenate(([0], np.cumsum(n)))
    assert shard.expand(shard.body).tolist() == ids.tolist()
    for k in range(30):
        assert shard.document(k).tolist() == ids[at[k]:at[k + 1]].tolist()
        a = int(rng.integers(0, n[k]))
        assert shard.document(k, a, 7).tolist() == ids[at[k] + a:min(at[k] + a + 7, at[k + 1])].tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_encoder_equals_whole_text(name):
    e = WordEncoder(public_path(name), cache_words=5)
    hard = ["", "  a", "   x y", "a\n b  \n\n  c ", "It's I'LL we'Re\tx  é é ΑΣ ΑΣ. İx 12 3½ ②", "a   ", "\n\n", "\n ", "x \n y", "a\r\n b",
            " <|endoftext|> a", "日本語 テスト。　 ok", "ﬁ ſ's", "a  b", "x\n  y", "...  ---", "don't, don't; 'S"]
    for t in hard:
        assert np.frombuffer(e([t])[0], "<u4").tolist() == e.tok.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_encoder_equals_untouched_tokenizer(name):
    from tokenizers import Tokenizer
    path = public_path(name)
    encode, tok = WordEncoder(path), Tokenizer.from_file(path)
    hard = ["see <|endoftext|> here", "plain words", "<|startoftext|>a<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> x", "İ.", " İstanbul  é", "", "</w> x"]
    for t, ids in zip(hard, encode(hard), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_texts_use_the_word_cache(name):
    e = WordEncoder(public_path(name))
    assert not any(e.whole(t) for t in (ENGLISH, FRENCH, "I like it, ENDOFTEXT <|ENDOFTEXT|>"))
    assert e.whole("a <|endoftext|> b")
    assert e.whole("\u0130.") == (name == "word_bpe_49k.json")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_batch_looks_a_word_up_once(name):
    class Counting(dict):
        looked = 0

        def get(self, key, default=None):
            self.looked += 1
            return super().get(key, default)

    e = WordEncoder(public_path(name))
    e.cache = Counting()
    words = [f"{a}{b}{c}" for a in "aeiou" for b in "rstl\u00e9" for c in "aeiou"]
    e([" ".join(words) + ", " + ". ".join(words)] * 40)
    assert e.cache.looked <= 3 * len(words)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_batch_of_pieces_equals_untouched_tokenizer(name):
    from tokenizers import Tokenizer
    path, rng = public_path(name), np.random.default_rng(5)
    pieces = ["a", "B", "'", "s", "LL", "'re", " ", "  ", "\n", "\t", "\xa0", "\x1c", "1", "\u00bd", "\u0663", ".", "--", "\u00e9", "e\u0301", "\u00df",
              "\u03a3", "\u017f", "\u0378", "\u65e5\u672c", "\U0001f44d", "\u0130", "<|endoftext|>", "\u00ad", "\u0301", "word", " the", "\u2028"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 12))) for _ in range(3000)]
    tok = Tokenizer.from_file(path)
    for t, ids in zip(texts, WordEncoder(path, cache_words=300)(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_tables_and_slices_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    class Docs:
        schema = quality.T.StructType([quality.T.StructField("text", quality.T.StringType())])

        def select(self, *_):
            return self

        def mapInArrow(self, f, schema):
            return f

    class Models:
        value = np.zeros(2 * quality.CELLS, np.float32), None

    def peak(f):
        tracemalloc.start()
        f()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 1e6

    textcodes.lower.cache_clear()
    assert peak(textcodes.lower) < 20
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 1_000_000] * 120})
    score = quality.weighted(Docs(), Models, [])
    list(score([batch.slice(0, 1)]))
    assert peak(lambda: list(score([batch]))) < 100


def test_packing(docs, nothing):
    path = public_path(packing.TOKENIZER)
    got = packing.packed(docs, path, window=64).collect()
    encode = WordEncoder(path)
    left = Counter((r[0], encode([r[1] or ""])[0] + (2).to_bytes(4, "little")) for r in rows())
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for s in seqs.values():
        at = 0
        for a, n in sorted(s):
            assert a == at
            at += n
        assert at <= 64
    for i in {r[0] for r in rows()} - {None, 300}:
        parts = sorted(pieces[i], key=lambda r: r.start)
        assert left[(i, b"".join(p.ids for p in parts))] == 1 and sum(p.length for p in parts) == parts[0].doc_tokens
    total = sum(len(x[1]) // 4 * c for x, c in left.items())
    assert sum(r.length for r in got) == total
    assert len(seqs) <= -(-total // 64) + docs.sparkSession.sparkContext.defaultParallelism
    assert packing.packed(nothing, path).collect() == []


def test_level_rule_is_least_sum_of_squares():
    rng = np.random.default_rng(1)
    p = packing.LevelPacker(20)
    for _ in range(300):
        size = int(rng.integers(1, 20))
        best = min(sum((p.count[1:20] + np.eye(21, dtype=int)[h + size][1:20] - (np.eye(21, dtype=int)[h][1:20] if h else 0)) ** 2)
                   for h in range(0, 21 - size) if h == 0 or p.count[h])
        h = p.level(size)
        assert sum((p.count[1:20] + np.eye(21, dtype=int)[h + size][1:20] - (np.eye(21, dtype=int)[h][1:20] if h else 0)) ** 2) == best
        p.place(size, None)


def test_mixing(docs, nothing):
    got = mixing.taken_words(docs).collect()
    assert len(got) == len(rows())
    by = defaultdict(list)
    for r in got:
        by[(r.source_size, r.target)].append(r)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(r.size for r in got)
    assert total == sum(len(regex.findall(mixing.WORDS, r[1] or "")) for r in rows())
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    for (size, target), rs in by.items():
        assert target <= 2 * size and sum(r.taken for r in rs) == round(target)
    assert sorted(map(tuple, mixing.taken_words(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.taken_words(nothing).collect() == []
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    assert max(Counter((r.doc_id, r.text) for r in whole.collect() if r.doc_id not in (None, 300)).values()) <= 2


def test_schedule_is_evenly_spread(spark):
    t = spark.createDataFrame([("=a", "a", 0, 600.0), ("=b", "b", 1, 300.0), (("null"), None, 2, 100.0)],
                              "skey string, source string, rank int, target double")
    got = mixing.schedule(t, 1000.0, 1).orderBy("slot").collect()
    assert Counter(r.skey for r in got) == {"=a": 600, "=b": 300, "null": 100}
    for s in ("=a", "=b", "null"):
        mine = [r for r in got if r.skey == s]
        assert [r.rank_in_source for r in mine] == list(range(len(mine)))
        assert len({r.slot for r in got}) == 1000
    seen = np.cumsum([r.skey == "=a" for r in got])
    assert abs(seen - 0.6 * np.arange(1, 1001)).max() < 6


def test_language(docs, nothing):
    learned = langid.training_text(docs.where("doc_id < 150"))
    got = langid.with_language(docs, learned)
    assert got.columns[:3] == ["doc_id", "text", "lang"] and got.columns[-3:] == ["lang_pred", "score", "bits"]
    out = {(r.doc_id, r.text): r for r in got.collect()}
    for (i, t), r in out.items():
        if not regex.search(r"\p{L}", t or ""):
            assert (r.lang_pred, r.score, r.bits) == ("und", 0.0, None)
        else:
            assert 0.5 <= r.score <= 1
        if i is not None and i < 150:
            assert r.lang_pred == ("en" if i < 100 else "fr")
    assert langid.with_language(nothing, learned).collect() == []
    assert {r.lang_pred for r in langid.with_language(docs, {}).collect()} == {"und"}


def test_cross_parsing_is_greedy_longest_match():
    texts = {"a": "abracadabra banana", "b": "the cat sat on the mat"}
    p = langid.Parser(texts)
    for t in ["abra cat", "zzz", "banana the bandana", "a", "mat on a cat, " * 60]:
        t = t.replace(",", "")                                # one space where the parser sees a run
        for j, lang in enumerate(p.langs):
            at = phrases = 0
            while at < len(t):
                n = 1
                while at + n < len(t) and t[at:at + n + 1] in texts[lang] and (at + n) % langid.PART:
                    n += 1
                at, phrases = at + n, phrases + 1
            n_chars = len(p.codes([t])[0])
            got = p([t])[0, j] * n_chars / p.bits[j]
            assert abs(got - phrases) <= 1


def most_mb(f):
    import tracemalloc
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_parser_is_made_in_little_more_memory_than_it_takes():
    codes = np.random.default_rng(1).integers(ord("a"), ord("a") + 26, 30_000)
    texts = {"a": "".join(map(chr, codes)) + "".join(map(chr, range(0x430, 0x450)))}
    size = langid.Parser(texts).table.nbytes / 1e6
    assert most_mb(lambda: langid.Parser(texts)) < 5 * size


def test_parser_goes_with_its_job(spark, docs):
    learned = langid.training_text(docs.where("doc_id < 150"))
    assert langid.with_language(docs, learned).count() == len(rows())
    langid.with_language(docs, learned).write.format("noop").mode("overwrite").save()

    def parsers(batches):
        import gc

        import pyarrow as pa
        for _ in batches:
            n = sum(type(x).__name__ == "Parser" and type(x).__module__ == "themescope.llm.langid" for x in gc.get_objects())
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})
    assert {r.n for r in spark.range(64, numPartitions=16).mapInArrow(parsers, "n long").collect()} == {0}


def test_folds_are_counted_one_at_a_time(monkeypatch):
    import pyarrow as pa

    class Sample:
        select = repartition = sortWithinPartitions = lambda self, *_: self

    monkeypatch.setattr(quality, "counted_cells", lambda df, count: count)
    count = quality.sample_counts(Sample(), quality.FOLDS)
    batch = pa.RecordBatch.from_pydict({"text": [ENGLISH] * 12, "_fold": [f for f in range(quality.FOLDS + 1) for _ in range(2)]})
    found = {}

    def run():
        for first, total in count([batch.slice(0, 3), batch.slice(3)]):
            found[first] = (int(total[:2 * quality.CELLS].sum()), int(total[3 * quality.CELLS]))
    assert most_mb(run) < 4 * 8 * quality.GROUP_CELLS / 1e6
    words, step = len(ENGLISH.split()), quality.GROUP_CELLS // quality.CHUNK
    # A word and a bigram each (cell 0 for the first word); toxic text counts in marks alone.
    assert found == {f * step: (4 * words if f < quality.FOLDS else 0, 2) for f in range(quality.FOLDS + 1)}


def exact_classes(table, threshold=0.8):
    words = {i: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()) for i, t in table.items()}
    sets = {i: Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter({(table[i] or "",): 1}) for i, w in words.items()}
    df = Counter(s for x in sets.values() for s in x)
    n = len(table)
    idf = {s: 1 + np.log((1 + n) / (1 + c)) / np.log(2 + n) for s, c in df.items()}
    label = {i: i for i in table}
    ids = sorted(table)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b
             and (low := sum(min(sets[a][s], sets[b][s]) * idf[s] for s in sets[a].keys() & sets[b].keys()))
             >= threshold * (sum(c * idf[s] for x in (a, b) for s, c in sets[x].items()) - low)]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_near_duplicates(spark, docs, nothing):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows())
    table = {r[0]: r[1] for r in rows() if r[0] is not None}
    want = exact_classes(table)
    for r in got:
        if r.doc_id is not None:
            assert r.class_id == want[r.doc_id]
            assert r.kept == (r.class_id == r.doc_id)
    assert minhash.near_duplicates(nothing).collect() == []
    kept = minhash.one_per_class(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids.pop(None) == 1 and ids == Counter(set(want.values()))


def test_near_duplicates_of_a_loose_group(spark):
    """Variants of one text, many of them similar to few others only."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    table = {}
    for i in range(90):
        t = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 7))):
            t[k] = f"v{rng.integers(0, 10 ** 6)}"
        table[i] = " ".join(t)
    got = minhash.near_duplicates(spark.createDataFrame(list(table.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == exact_classes(table)


def test_near_duplicates_sends_few_rows_at_a_time(spark, docs, monkeypatch):
    """The jobs that send texts to Python hold at most BATCH_ROWS of them in a batch, whatever the session says."""
    sent, written = {}, minhash.written

    def noted(df, name):
        sent[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return written(df, name)
    monkeypatch.setattr(minhash, "written", noted)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    minhash.classes(docs)
    assert max(sent["signatures"], sent["vectors"]) <= minhash.BATCH_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_sampler_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    ids = np.sort(rng.choice(1 << 48, 3000, False).astype(np.uint64))
    w = rng.uniform(1, 2, 3000).astype(np.float32)
    s = minhash.Sampler(2048)
    one, two = s(np.array([0]), ids[:2200], w[:2200])[0], s(np.array([0]), ids[800:], w[800:])[0]
    true = w[800:2200].sum() / w.sum()
    assert abs((one == two).mean() - true) < 0.05


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (2, 2), (8, 7), (10, 11), (11, 12), (12, 13), (13, 14)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}


def vector_rows(seed, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    out = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * [0.05, 0.3, 0.6][i % 3]], i % 2) for i in range(n)]
    out += [(n, None, 0), (n + 1, [1.0, None] + [0.0] * 6, 0), (n + 2, [float("nan")] * 8, 1), (n + 3, [0.0] * 8, 1),
            (n + 4, out[0][1], None), (n + 5, out[0][1], 0), (n + 6, [1e200] * 8, 1), (n + 7, [1e200] * 8, 1), (n + 8, [], 0), (None, out[0][1], 0)]
    return out


@pytest.mark.parametrize("block", [2048, 40])
def test_cover_tree(spark, block, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", block)
    data = vector_rows(3)
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.vec_id: r for r in covertree.near_vectors(df).collect()}
    assert len(got) == len(data)
    live = [(i, np.array(v) / np.abs(v).max(), la) for i, v, la in data
            if i is not None and la is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for i, v, la in live:
        for j, u, lb in live:
            if i != j and la == lb and v @ u / np.sqrt((v @ v) * (u @ u)) >= 0.93:
                links[i].add(j)
    assert sum(map(len, links.values())) > 200
    for i, _, _ in data:
        if i is None:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, None, True)
            continue
        reach, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - reach)
            reach |= new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(reach), min(reach) == i)
    assert covertree.near_vectors(df.where("false")).collect() == []


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "HEAD", 20)
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "AXES", 3)
    data = [r for r in vector_rows(4, 300) if r[0] is None or abs((r[1] or [0])[0] or 0) < 1e100]
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<double>, label int, score string")
    got = sorted(tuple(r) for r in topk.top_k(df, every=20).collect())
    live = {i: [int(np.floor(1024 * x)) for x in v] + [0] * (8 - len(v)) for i, v, _ in data
            if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(i for i in live if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(live[q], live[c])), c) for c in live if c != q)[:10]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.where("vec_id = 100 or vec_id = 7"), every=20).count() == 1
    assert topk.top_k(df.where("false")).collect() == []


def test_search_sends_the_driver_no_blocks(spark, monkeypatch):
    """Query blocks times vector blocks meet in a shuffle, and the driver gets a few rows, however many there are."""
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "HEAD", 20)
    monkeypatch.setattr(topk, "SAMPLE", 64)
    monkeypatch.setattr(topk, "SHELVES_PER_CORE", 1, raising=False)
    plans, collected, real, svd = {}, [], topk.written, np.linalg.svd

    def spied(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(topk, "written", spied)
    monkeypatch.setattr(np.linalg, "svd", lambda a, *x, **y: collected.append(len(a)) or svd(a, *x, **y))
    rng = np.random.default_rng(8)
    v = {i: np.floor(1024 * rng.normal(0, 1, 6)) / 1024 for i in range(600)}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "vec_id long, embedding array<double>").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(df, every=20).collect())
    want = []
    for q in range(0, 600, 20):
        best = sorted((-int((v[q] * 1024) @ (v[c] * 1024)), c) for c in v if c != q)[:10]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == want
    assert "SortMergeJoin [shelf" in plans["hits"] and not collected
    joins = [x for x in plans["hits"].splitlines() if "BroadcastHashJoin" in x]
    assert len(joins) == 1 and "[part#" in joins[0]          # the numbers of the blocks
    none = spark.createDataFrame([(20, []), (7, [])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(none, every=20).collect()] == [(20, 1, 7, 0)]


def test_quality(spark, docs, nothing):
    junk = "BUY!! NOW!! ### $$$ "
    more = spark.createDataFrame([(1000 + i, ENGLISH * 2 + (junk * 5 if i % 2 else f" and {i} more"), "en", "a", 1, *"xyzsp") for i in range(200)], SCHEMA)
    labels = spark.createDataFrame([(1000 + i, 1 - i % 2, 0) for i in range(0, 150)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.resampled(docs.unionByName(more), labels).collect()
    assert len(got) == len(rows()) + 200
    picked = {r.doc_id: r.selected for r in got if r.doc_id is not None}
    assert not any(picked[1000 + i] for i in range(1, 200, 2))
    assert sum(picked[1000 + i] for i in range(0, 200, 2)) >= 98
    for r in got:
        if not (r.text or "").strip():
            assert (r.selected, r.log_weight, r.gumbel_key) == (False, None, None)
    assert quality.resampled(nothing, labels).collect() == []
    assert all(r.selected == bool((r.text or "").strip()) for r in quality.resampled(docs, labels.where("false")).collect())


@pytest.fixture(scope="module")
def held_out_recall(spark):
    """(dropped, all) of labelled documents that the model did not see, by kind and language or length."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = F.pmod(F.xxhash64(F.lit(77), "doc_id"), F.lit(5)) == 0
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("junk")
    size = F.when(F.size(F.split("text", r"\s+")) >= 1000, "long").otherwise("short")
    got = (quality.resampled(docs, labels.where(~out)).join(labels.where(out), "doc_id")
           .select(kind.alias("kind"), F.explode(F.array("lang", size)).alias("of"), "selected")
           .groupBy("kind", "of").agg(F.sum(F.when(F.col("selected"), 0).otherwise(1)), F.count(F.lit(1))).collect())
    return {(r[0], r[1]): (r[2], r[3]) for r in got}


def test_clean_documents_outside_the_fit_stay(held_out_recall):
    for of in ("en", "de", "fr", "es", "short", "long"):
        dropped, n = held_out_recall["clean", of]
        assert n > 20 and dropped <= max(2, 0.02 * n), of
    assert sum(held_out_recall["junk", of][0] for of in ("short", "long")) >= 0.9 * sum(held_out_recall["junk", of][1] for of in ("short", "long"))


def test_toxic_documents_outside_the_fit_go(held_out_recall):
    dropped, n = map(sum, zip(*(held_out_recall["toxic", of] for of in ("de", "fr", "es"))))
    assert n > 20 and dropped >= 0.8 * n
    assert held_out_recall["toxic", "en"][0] >= 0.95 * held_out_recall["toxic", "en"][1]


def test_toxic_evidence_is_that_of_the_worst_words():
    evidence = -np.random.default_rng(0).random(quality.CELLS + 1).astype(np.float32)
    evidence[-1] = 0
    for t in ["", "one", ENGLISH, "a ab abc abcd abcdefghijk", "réeuxment, çaX"]:
        kinds, _ = quality.mark_cells([t])
        each = sorted(min(float(evidence[c]) for c in word) for word in zip(*kinds))
        assert quality.toxic_evidence(["b c", t, "d " * 30], evidence)[1] == pytest.approx(sum(each[:quality.WORST]), abs=1e-4)


def test_levels_of_small_groups(spark):
    rows = [("a", 2, i / 1000) for i in range(1000)] + [("a", 3, -5.0), ("b", 2, -1.0)]
    levels = quality.Levels(spark.createDataFrame(rows, "_lang string, _size int, x double"), "x")
    new = spark.createDataFrame([("a", 2, 0.0), ("a", 3, 0.0), ("b", 2, 0.0), ("b", 3, 0.0), ("c", 5, 0.0)], "_lang string, _size int, x double")
    got = {(r._lang, r._size): round(quality.TEMPERATURE - r.x, 9) for r in levels.relative(new, "x").collect()}
    one = {k: sorted(x for la, si, x in rows if k in (la, si, ""))[max(0, int(np.ceil(quality.TAIL * sum(k in (la, si, "") for la, si, _ in rows))) - 1)]
           for k in ("a", "b", 2, 3, "")}
    assert got == {("a", 2): sorted(i / 1000 for i in range(1000))[int(np.ceil(quality.TAIL * 1000)) - 1], ("a", 3): min(one["a"], one[3]),
                   ("b", 2): min(one["b"], one[2]), ("b", 3): min(one["b"], one[3]), ("c", 5): sorted(x for *_, x in rows)[int(np.ceil(quality.TAIL * 1002)) - 1]}


def test_sample_is_spread_over_groups(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "es").otherwise("en").alias("_lang"), F.lit(2).alias("_size"))
    got = [r.doc_id for r in quality.stratified(ids, 1000).collect()]
    assert 200 <= sum(i < 300 for i in got) and len(got) <= 1100
    assert quality.stratified(ids, 40_000).count() == 20_000


def test_log_weight_is_the_weakest_passage():
    ratios = np.random.default_rng(0).normal(size=2 * quality.CELLS).astype(np.float32)
    ratios[quality.CELLS] = 0
    for t in ["", "one", ENGLISH, "a a a b " * 9, "x " * 8, "x " * 9]:
        one, two, _ = quality.ngram_cells([t])
        each = (ratios[one] + ratios[quality.CELLS + two]).astype(float)
        want = min([each[i:i + 8].sum() for i in range(max(1, len(each) - 7))], default=0)
        got = quality.log_weights(["b c", t, "d " * 30], ratios)[1]
        assert got == pytest.approx(want, abs=1e-4)


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(0).normal(size=500)] + [7.0] * 5 + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "k double")
    for k in (1, 2, 4, 6, 250, len(values)):
        assert quality._kth_largest(df, k, "k") == sorted(values, reverse=True)[k - 1]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_round_trip(spark):
    texts = [chat.PLANTED, None, "", " <s> ", r"<\/s> <\\/s>", "[[INST] <<<SYS>>", "<</ROLE>> <</TURN>>", "é\n[/INST", "</s></s><s>[INST][/INST]"]
    data = [(c, t, ["user", "assistant", "system", "tool </s>", None][(c + t) % 5], texts[(c * 3 + t) % len(texts)], "x") for c in range(9) for t in range(7)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    out = chat.render(chat.fold(chat.message_log(df)))
    got = out.select("conv", "formatted", "loss_spans", chat.parse("formatted").alias("turns"),
                     chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(got) == 9
    for r in got:
        turns = [(ro or "", t or "") for c, _, ro, t, _ in data if c == r.conv]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss == "".join(t for ro, t in turns if ro == "assistant")
        assert all(not any(m in r.formatted[s.start:s.start + s.length] for m in ("</s>", "[INST]", "[/INST]", "<s>")) for s in r.loss_spans)
    assert chat.render(chat.fold(chat.message_log(df.where("false")))).collect() == []


def test_fold_of_streams(spark):
    log = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "Hel"), (1, 3, 1, "delta", "assistant", "lo"),
           (1, 4, 2, "message", "user", "more"), (1, 5, 3, "delta", "assistant", "x"),
           (1, 6, 1, "regenerate", "assistant", "B"), (1, 7, 1, "delta", "assistant", "ye"), (1, 8, 2, "message", "user", "again"),
           (1, 9, 3, "delta", "assistant", "lon"), (1, 10, 3, "edit", "assistant", "short"), (1, 11, 3, "delta", "assistant", "er"),
           (2, 1, 0, "edit", "user", "only"), (None, 1, 0, None, None, None)]
    got = chat.fold(spark.createDataFrame(log, "conv long, seq long, turn long, kind string, role string, text string")).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.turn, r.seq)):
        by[r.conv].append((r.role, r.text))
    assert by == {1: [("user", "hi"), ("assistant", "Bye"), ("user", "again"), ("assistant", "shorter")], 2: [("user", "only")], None: [(None, "")]}


def test_crc_and_sizes_of_query(spark):
    r = sharding.query(spark, "/root/testdata/sf0.001").first()
    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    assert (r.size, r.text_crc32) == (len(t.encode()) + 8, zlib.crc32(t.encode()))


def test_pipeline_stages(spark):
    import corpus_pipeline as C
    from themescope.session import scratch_path
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    for name, stage in C.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if name != C.STAGES[-1][0]:
            assert after.columns == cols
            before = {r.doc_id: r.text for r in docs.collect()}
            assert all(before[r.doc_id] == r.text for r in after.collect())
        if name == "MinHash near-dedup":
            want = exact_classes({r.doc_id: r.text for r in docs.collect()})
            # idf of the operator counts hashed cells; classes agree with exact counts here.
            assert {r.doc_id for r in after.collect()} == set(want.values())
        docs = after
    assert Row(*docs.columns) and docs.count() > 0


def test_search_of_repeated_query_rows(spark):
    """Equal query rows are one query; other vectors of the same id are queries of their own."""
    rng = np.random.default_rng(4)
    v = [(i, rng.normal(0, 1, 6).round(3).tolist()) for i in range(1, 60)]
    one, other = rng.normal(0, 1, 6).round(3).tolist(), rng.normal(0, 1, 6).round(3).tolist()
    data = v + [(100, one), (100, one), (200, one), (200, other), (300, other), (300, other), (300, other)]
    got = Counter(tuple(r) for r in topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect())
    want = Counter()
    for i, e in {(i, tuple(e)) for i, e in data if i % 100 == 0}:
        q = np.floor(1024 * np.array(e)).astype(int)
        scores = sorted((-int(q @ np.floor(1024 * np.array(x)).astype(int)), j) for j, x in data if j != i)
        want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:10]))
    assert got == want


def test_different_texts_of_one_id_stay(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine", "red green blue black white grey pink")
    df = spark.createDataFrame([(1, a, 7, "x"), (1, b, 7, "x"), (2, b, 7, "x"), (3, c, 7, "x"), (3, c, 7, "x"), (None, a, 7, "x"), (4, None, 7, "x"),
                                (4, c, 7, "x")], "doc_id long, text string, _id int, _key string")
    left = minhash.one_per_class(df)
    assert left.columns == df.columns
    # The least id of a class, an id with several texts after all others.
    rows = sorted((r.doc_id, r.text or "") for r in left.collect())
    assert rows == [(1, a), (2, b), (3, c), (4, "")]
    got = sorted(((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 2), (2, 2), (3, 3), (3, 3), (None, 1), (4, 4), (4, 3)], key=str)


def test_stages_keep_input_columns_named_like_theirs(spark):
    import corpus_pipeline as C
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = {"score": F.col("doc_id") * 2, "Bits": F.lit("b"), "lang_pred": F.lit("mine"), "log_weight": F.lit(None).cast("int"), "selected": F.lit(False),
           "gumbel_key": F.lit(-1), "_lang": F.lit("q"), "_size": F.lit(1.5), "_row": F.lit(0), "_noise": F.lit("n"), "toxic": F.lit(1),
           "_docs_row": F.lit(3), "level": F.lit(4)}
    more = docs.withColumns(own)
    rows = [r for r in more.collect() for _ in range(1 + (r.doc_id % 50 == 0))]                      # some rows stand twice
    rows += [(None, *rows[0][1:]), (10**9, None, *rows[0][2:]), (10**9 + 1, "", *rows[0][2:])]
    more = spark.createDataFrame(rows, more.schema)
    whole = {tuple(r) for r in more.collect()}
    for stage in (C.quality_classifier, C.language_id):
        after = stage(spark, more, sf)
        assert after.columns == more.columns
        got = after.collect()
        assert got and {tuple(r) for r in got} <= whole
        assert not any(r.doc_id in (10**9, 10**9 + 1) for r in got)
        ids = Counter(r.doc_id for r in got)
        assert all(ids[d] in (0, 2) for d in range(0, 200, 50))                                      # copies share their fate
        assert stage(spark, more.where("false"), sf).collect() == []
