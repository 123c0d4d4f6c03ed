"""The pipeline's stages on their own inputs, and the query registry."""

import __spark_entry__
import corpus_pipeline
from braidwork.llm import decontamination, mixing, near_dedup, sharding, toxicity
from tests.llm.test_operators import judge_plainly, longest, plain, water_filling


def test_stages_have_their_effects(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        found[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema.simpleString() == docs.schema.simpleString()
        docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = found["toxicity"]
    lexicon = toxicity.learn_lexicon(before, spark.read.parquet(f"{folder}/labels.parquet"))
    assert ids(before) - ids(after) == ids(toxicity.toxic_clauses(before, lexicon)) != set()
    before, after = found["near duplicates"]
    groups = near_dedup.near_duplicates(before).collect()
    assert ids(before) - ids(after) == {r.doc_id for r in groups if r.doc_id != r.kept_id} != set()
    before, after = found["decontamination"]
    assert ids(before) - ids(after) == ids(decontamination.matches(before, spark.read.parquet(f"{folder}/benchmark.parquet"), least_item=decontamination.LEAST_ITEM))
    before, after = found["mixing"]
    assert ids(after) <= ids(before)
    before, after = found["sharding"]
    assert after.columns == [*before.columns, "shard"] and after.count() == before.count()
    assert corpus_pipeline.run(spark, folder).count() == after.count()


def pipeline_plainly(docs, benchmark, lexicon):
    """(doc_id, shard, copies) of run(), by brute force: clause by clause, all pairs, common runs, water filling round by round, one slot a document."""
    import hashlib

    import xxhash

    docs = [d for d in docs if judge_plainly(d["text"], lexicon)[0] < toxicity.REJECT]
    sets = {}
    for d in docs:
        w = plain(d["text"] or "")
        sets[d["doc_id"]] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)
    gone, ids = set(), sorted(i for i in sets if sets[i])
    near = {i: [j for j in ids if i != j and 0.6 <= min(len(sets[i]), len(sets[j])) / max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= near_dedup.THRESHOLD] for i in ids}
    for i in ids:
        todo = [] if i in gone else [i]
        while todo:
            for j in near[todo.pop()]:
                if j != i and j not in gone:
                    gone.add(j)
                    todo.append(j)
    docs = [d for d in docs if d["doc_id"] not in gone]
    hit = lambda t: any(longest(t, b)[0] >= min(13, len(b)) for b in items if set(b) & set(t))
    items = [plain(b) for b in benchmark]
    docs = [d for d in docs if not hit(plain(d["text"] or ""))]
    sizes = {}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + len(d["text"] or "")
    rates = water_filling(sizes, {s: mixing.TARGETS.get(s, mixing.DEFAULT_WEIGHT) for s in sizes}, mixing.MAX_EPOCHS)
    owner = sharding.lookup_table(sharding.shard_names())
    out = {}
    for d in docs:
        rate = round(rates[d["source"]], mixing.DECIMALS)
        draw = int(hashlib.md5(f"{mixing.SEED}/{d['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        if copies := int(rate) + (draw < rate - int(rate)):
            h = xxhash.xxh64(d["doc_id"].to_bytes(8, "little", signed=True), seed=42).intdigest()
            out[d["doc_id"]] = (int(owner[(h - (1 << 64) if h >> 63 else h) % sharding.SLOTS]), copies)
    return out


def test_run_against_brute_force(spark, folder):
    docs, benchmark = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    lexicon = toxicity.learn_lexicon(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = pipeline_plainly([r.asDict() for r in docs.collect()], [r.text for r in benchmark.collect()], lexicon)
    got = {}
    for r in corpus_pipeline.run(spark, folder).select("doc_id", "shard").collect():
        got.setdefault(r.doc_id, []).append(r.shard)
    assert {i: (s[0], len(s)) for i, s in got.items()} == want and all(len(set(s)) == 1 for s in got.values()) and want


def test_registry_has_all_ten_and_the_pipeline():
    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_stages_take_odd_and_empty_tables(spark, folder):
    from pyspark.sql import functions as F

    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, long, "en", None, 5), (None, "no id here", "en", "b", 1), (4, "word", "en", "b", 4), (4, "word", "en", "b", 4), (5, long, "en", "c", 5), (None, None, None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("shard", F.lit(None).cast("string")).withColumn("Mix_Copies", F.lit(1)).withColumn("row_of_id", F.lit(2))
    left = {"toxicity": 8, "near duplicates": 6, "decontamination": 8, "sharding": 8}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder)
        assert out.columns[: len(odd.columns)] == odd.columns
        assert out.count() == left.get(name, out.count())
        assert stage(spark, odd.limit(0), folder).count() == 0
