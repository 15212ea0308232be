"""The pipeline and the registry: each stage against brute force on its own input, and the whole against the stages."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blocklake.llm import line_dedup, registry, secret_scan, shingle_join
from blocklake.llm.common import written
from tests.llm.test_corpus_operators import BASE, brute_report, classes
from tests.llm.test_text_operators import brute_statistics

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """The input and the output of every stage, each written and read again."""
    root, out = tmp_path_factory.mktemp("stages"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{root}/{i}")
        out.append(spark.read.parquet(f"{root}/{i}"))
    return [x.toPandas() for x in out]


def test_columns(results):
    for frame in results[1:-1]:
        assert list(frame.columns) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(spark, results):
    before, after = results[0], results[1]
    kept = set(after.doc_id)
    for k, t in zip(before.doc_id, before.text, strict=True):
        words, _, _, _, repeated = brute_statistics(t)
        if words < 20 or 100 * repeated > 30 * words:
            assert k not in kept
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good = {k for k, q in zip(labels.doc_id, labels.quality, strict=True) if q == 1}
    failed = {k for k, t in zip(before.doc_id, before.text, strict=True) if brute_statistics(t)[0] < 20 or 100 * brute_statistics(t)[4] > 30 * brute_statistics(t)[0]}
    assert good - failed <= kept and not kept & (set(labels.doc_id) - good)


def test_lines(results):
    before, after = results[1], results[2]
    rows = list(zip(before.doc_id, before.text, strict=True))
    dropped = {(k, i) for k, i, *_, kept in brute_report(rows, line_dedup.DISTANCE, line_dedup.PER) if not kept}
    want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in dropped) for k, t in rows}
    assert dict(zip(after.doc_id, after.text, strict=True)) == {k: t for k, t in want.items() if t.strip()} and dropped


def shingles(t, width=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_near_duplicates(results):
    """One document of each group of five-word sets that are similar, by all pairs."""
    before, after = results[2], results[3]
    sets = {k: shingles(t) for k, t in zip(before.doc_id, before.text, strict=True)}
    groups = classes(list(sets), [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))])
    assert sorted(after.doc_id) == sorted(min(g) for g in groups)


@pytest.mark.parametrize("common, rounds", [(32, 2), (1, 0)])
def test_five_word_near_copies(spark, common, rounds):
    """Copies with a few words changed, far beyond two bits of a fingerprint, in groups small and crowded; against all pairs."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randrange(30, 160))]
        for _ in range(8):
            copy = list(base)
            for _ in range(r.randrange(5)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(copy[: len(copy) - r.randrange(12)])
    passage = [r.choice(words) for _ in range(30)]
    rows += [passage + [r.choice(words) for _ in range(r.randrange(2, 60))] for _ in range(60)]
    texts = [" ".join(x) for x in rows] + ["a b", "A  b", "", None]
    r.shuffle(texts)
    sets = [shingles(t) for t in texts]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    want = classes(range(len(sets)), [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])])
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = shingle_join.near_duplicates(df, common=common, rounds=rounds).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in got) == sorted((i, min(g)) for g in want for i in g)
    if common == 32:
        assert sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, df, SF).collect()) == sorted(min(g) for g in want)


def test_secrets(results):
    """Live values masked and nothing else, against patterns and counts of the test's own."""
    before, after = results[3], results[4]
    found, owners = {}, {}
    for k, t, source in zip(before.doc_id, before.text, before.source, strict=True):
        spans = [(m.start(), m.end(), m.group(group)) for pattern, group, least in BASE for m in pattern.finditer(t) if len(m.group(group)) >= least]
        spans += [(m.start(), m.end(), m.group(kind.group)) for kind in secret_scan.KINDS[3:] for m in re.finditer(kind.pattern, t, re.A) if len(m.group(kind.group)) >= kind.least]
        found[k] = spans
        for *_, value in spans:
            owners.setdefault(value, (set(), set()))[0].add(source)
            owners[value][1].add((source, k))
    live = {v for v, (o, d) in owners.items() if len(o) <= 2 and len(d) <= 10 and len(set(v)) >= 6 and not re.search(secret_scan.PLACEHOLDERS, v)}
    want = {}
    for k, t in zip(before.doc_id, before.text, strict=True):
        out, at = "", 0
        for a, b in sorted((b - len(v), b) for _, b, v in found[k] if v in live):
            out += t[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        want[k] = out + t[at:]
    assert dict(zip(after.doc_id, after.text, strict=True)) == want and any("[SECRET]" in t for t in want.values())


def test_packing(results):
    before, after = results[4], results[5]
    assert sorted(before.doc_id) == sorted(after.doc_id) and (after.padding >= 0).all()
    words = {k: brute_statistics(t)[0] for k, t in zip(before.doc_id, before.text, strict=True)}
    assert all(words[k] == n for k, n in zip(after.doc_id, after.n_tokens, strict=True))
    for _, rows in after.groupby(["bucket", "batch"]):
        assert len(rows) == 1 or len(rows) * rows.bucket_tokens.iloc[0] <= 65_536


def test_run_is_its_stages(spark, results):
    rows = lambda f: sorted(map(str, f.itertuples(index=False)))
    got = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "n_tokens", "bucket", "bucket_tokens", "padding"]
    assert rows(got[key]) == rows(results[-1][key])


def test_odd_documents(spark):
    from tests.llm.fixtures import documents, empty

    for df in (documents(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df.drop("key"), SF)
            assert out.count() <= df.count()


COLUMNS = {
    "op1_license_scan": "doc_id bigint n_words bigint n_base bigint first_word bigint last_word bigint base_labels string labels string score double",
    "op2_warc": "page_id bigint payload_bytes bigint payload_digest string record_type string refers_to bigint",
    "op3_secret_scan": "doc_id bigint n_assign bigint n_access bigint n_hex bigint base_sha256 string spans string",
    "op4_html_extraction": "page_id bigint url string text string n_chars bigint",
    "op5_line_dedup": "doc_id bigint line_no int class_key bigint class_line int n_links bigint n_copies bigint kept boolean",
    "op6_byte_bpe": "doc_id bigint n_tokens bigint ids_sha256 string decoded_sha256 string",
    "op7_packing": "doc_id bigint n_tokens bigint bucket int bucket_tokens bigint batch bigint slot int padding bigint",
    "op8_quality_rules": "doc_id bigint n_words bigint word_chars bigint n_symbols bigint n_dup_lines bigint n_repeat_words bigint base_failed boolean kept boolean",
    "op9_simhash": "doc_id bigint fingerprint string component_id bigint",
    "op10_document_fingerprint": "doc_id bigint n_chars bigint edited_sha256 string fingerprint string edited_fingerprint string near_edited double near_next double",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns(spark, name):
    """Every registered query: its columns with their kinds, a row for each row of its table (for each line in op5)."""
    out = registry.queries()[name](spark, SF)
    want = COLUMNS[name].split()
    assert dict(zip(want[::2], want[1::2], strict=True)).items() <= dict(out.dtypes).items()
    rows = spark.read.parquet(f"{SF}/{'pages' if want[0] == 'page_id' else 'documents'}.parquet")
    key = out.select(want[0]).distinct().count()
    assert key == rows.count() and (name == "op5_line_dedup" or out.count() == key)
    if name == "op9_simhash":
        assert out.where("NOT fingerprint RLIKE '^[0-9a-f]{16}$' OR component_id > doc_id").isEmpty()


def test_registry():
    names = registry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_common_shingles_cost_little():
    """A set's first shingles are those by membership, and the work for a set hardly grows with the number of common shingles."""
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**64, 400, dtype=np.uint64)).view(np.int64) for _ in range(40)]

    def seconds(n):
        common = np.sort(np.concatenate([*[s[::7] for s in sets], r.integers(-(2**63), 2**63, n)]))
        began = time.process_time()
        got = [shingle_join.first_shingles(s, (4, 5), common) for s in sets]
        took = time.process_time() - began
        for s, g in zip(sets, got, strict=True):
            late = set(common.tolist())
            order = [x for x in s.tolist() if x not in late] + [x for x in s.tolist() if x in late]
            assert g.tolist() == order[: len(s) - -(-4 * len(s) // 5) + 1]
            if n:
                break
        return took

    seconds(0)
    assert seconds(300_000) < 20 * seconds(0) + 0.2


def test_shingle_hashes_tell_runs_apart():
    texts = ["a b c d e f g", "a b c d e", "b a c d e", "a b c d", "a b", "a", "A  B c\td e", "ab c d e f"]
    runs = {}
    for t in texts:
        words = t.lower().split()
        for i, h in enumerate(shingle_join.shingle_hashes(t.encode(), 5).tolist()):
            assert runs.setdefault(h, words[i : i + 5]) == words[i : i + 5]
    assert len(runs) == len({tuple(x) for x in runs.values()}) == 8 and len(shingle_join.shingle_hashes(b" \n", 5)) == 0


def test_near_duplicates_store_no_sets_of_all_texts(spark, monkeypatch):
    """Sets of hashes take several times the disk of packed texts: only those of pairs that may be similar are stored."""
    stored = {}

    def noted(df, name, *rest, put=shingle_join.written):
        out = put(df, name, *rest)
        stored[name] = max(stored.get(name, 0), out.count()) if "found" in out.columns else 0
        return out

    monkeypatch.setattr(shingle_join, "written", noted)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (60, texts[7] + " end"), (61, texts[7])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.near_duplicates(df).collect()}
    assert got == {i: i for i in range(60)} | {60: 7, 61: 7}
    assert max(stored.values()) == 2


def test_written_tables_leave_no_shuffle_files(spark):
    kept = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("c"))
    before = kept()
    written(df, "no-shuffles")
    for _ in range(50):  # files go a moment later
        if kept() <= before:
            break
        time.sleep(0.1)
    assert kept() <= before
