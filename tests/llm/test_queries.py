"""The registered queries: twins in SQL, and the pipeline against a brute-force version."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
import xxhash

import corpus_pipeline
from placewise.llm import quality
from placewise.llm.queries import QUERIES
from placewise.llm.sql import ORACLE_SQL
from tests.llm.test_operators import WORD, brute_groups, brute_lines, brute_quality, brute_rates, spark_draw

COLUMNS = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op2": "doc_id size text_crc32 law shard slot grown_shard", "op4": "doc_id n_bytes n_tokens over_limit",
    "op5": "doc_id n_tokens ids_sha256 decoded_sha256", "op6": "doc_id n_lines n_dropped kept_sha256", "op7": "doc_id fingerprint component_id", "op8": "doc_id source lang topic tokens rate kept copies", "op3": "page_id text n_chars",
    "op9": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op10": "page_id payload_bytes payload_digest record_type refers_to",
    "op11": "query_id rank vec_id score", "op12": "doc_id n_features weight score rank", "op13": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract_columns(spark, sf_dir, name):
    want = COLUMNS.get(name.split("_")[0], "").split()
    assert QUERIES[name](spark, sf_dir).columns[: len(want)] == want


@pytest.fixture(scope="module")
def whole_texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_op4_whole(spark, sf_dir, whole_texts):
    """Every column as the library gives it."""
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    n = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in whole_texts.items()}
    want = {(i, len(t.encode()), n[i], n[i] > 2048) for i, t in whole_texts.items()}
    assert {tuple(r) for r in QUERIES["op4_token_counts"](spark, sf_dir).collect()} == want


def test_op5_whole(spark, sf_dir, whole_texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = set()
    for i, t in whole_texts.items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op5_sentencepiece"](spark, sf_dir).collect()} == want


def test_op7_whole(spark, sf_dir, whole_texts):
    """Fingerprints bit by bit from their definition, components by comparing all pairs."""
    prints = {}
    for i, t in whole_texts.items():
        words = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    least = {i: i for i in prints}
    for i in sorted(prints):  # smallest ids first, so each is reached from the smallest of its component
        queue = [i] if least[i] == i else []
        while queue:
            a = queue.pop()
            for b in prints:
                if least[b] > i and (prints[a] ^ prints[b]).bit_count() <= 2:
                    least[b] = i
                    queue.append(b)
    want = {(i, f"{p:016x}", least[i]) for i, p in prints.items()}
    assert {tuple(r) for r in QUERIES["op7_simhash_near_dedup"](spark, sf_dir).collect()} == want


def brute_quality_kept(text):
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = brute_quality(text)
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    stops = sum(w.lower() in quality.STOP_WORDS for w in words)
    per = lambda x, n: x / n if n else 0.0
    bullets, trailing = sum(x.lstrip(quality.WHITE_CHARS).startswith(quality.BULLETS) for x in lines), sum(x.rstrip(quality.WHITE_CHARS).endswith(("...", "…")) for x in lines)
    bad = n_words < 10 or 100 * n_repeat > 20 * n_words or not 2 <= per(word_chars, n_words) <= 15 or per(n_symbols, n_words) > 0.3
    return not (bad or per(stops + 1, n_words) < 0.03 or per(n_dup_lines, len(lines)) > 0.5 or per(bullets, len(lines)) > 0.9 or per(trailing, len(lines)) > 0.5)


def checked_stages(spark, docs, sf_dir, tmp_path):
    """Each stage on its own input against a brute-force version; the last result."""
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = out.collect()
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "quality_rules":
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if brute_quality_kept(r.text))
        elif name == "line_dedup":
            want = brute_lines({i: r.text for i, r in enumerate(before)}) if len({r.doc_id for r in before}) == len(before) else None
            if want and all(r.doc_id is not None for r in before):
                want = brute_lines({r.doc_id: r.text for r in before})
                assert {r.doc_id: r.text for r in after} == {i: x[2] for i, x in want.items()}
            assert len(after) == len(before) and all(r.n_chars == len(r.text) for r in after)
        elif name == "simhash_near_dedup":
            groups = brute_groups({i: r.text for i, r in enumerate(before)})
            least = {}
            for i, r in enumerate(before):
                key = (r.doc_id is None, r.doc_id)
                least[groups[i]] = min(least.get(groups[i], key), key)
            assert sorted((r.doc_id is None, r.doc_id) for r in after) == sorted(least.values())
        elif name == "mixing":
            want = brute_rates([(i, r.text, r.source, r.lang) for i, r in enumerate(before)])
            copies = Counter()
            for i, r in enumerate(before):
                copies[r.doc_id] += int(want[i][2] + 1e-9) + (spark_draw(r.doc_id, r.text) < (want[i][2] + 1e-9) % 1)
            assert Counter(r.doc_id for r in after) == +copies
        else:
            want = Counter()
            for r in before:
                ids = np.array(library.encode(r.text or "", add_bos=True, add_eos=True), "<u4")
                want[r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(library.decode(ids.tolist()).encode()).hexdigest()] += 1
            assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == want
        docs = out
    return docs


def test_pipeline_stages(spark, sf_dir, tmp_path):
    last = checked_stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, tmp_path)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, last.collect()))


def test_pipeline_stages_on_odd_rows(spark, sf_dir, tmp_path):
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choice("the of and a to in river stone house light paper garden winter".split()) + f"{rng.randrange(99)}" * (i % 3 == 0) + " the" * (i % 9 == 0) for i in range(rng.randint(30, 80)))
    line = "\nThis line of more than forty characters stands in many documents"
    texts = [prose() + (line if i % 3 else "") for i in range(24)] + ["the " + "word of a very long text and more " * 1, "x" * 60_000, None, "", " \n"]
    long = " ".join(f"w{rng.randrange(10**6)} the of" for _ in range(20_000))
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 2}", len(t or ""), i, "x") for i, t in enumerate([*texts, long])]
    rows += [rows[0], rows[1], (None, texts[2], "en", "s0", 1, 2, None), (None, texts[3] + " more the of", "en", None, 1, 2, "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, mix long, Lines string"
    df = spark.createDataFrame(rows, schema)
    assert checked_stages(spark, df, sf_dir, tmp_path / "odd").count() > 10
    assert checked_stages(spark, df.limit(0), sf_dir, tmp_path / "none").count() == 0


def test_pipeline_mixes_by_topics_of_all_texts(spark):
    """The mixing stage on 5,000 texts draws each as often as a plain loop does that counts words and pairs in all of them."""
    rng = random.Random(7)
    words = {la: [f"{la}{i}" for i in range(30)] for la in ("en", "de")}
    rows = []
    for i in range(5_000):
        la = rng.choices(["en", "de"], (4, 1))[0]
        at = rng.randrange(30)
        rows.append((i, " ".join(rng.choice(words[la][at:] + words[la]) for _ in range(rng.randint(3, 20))), rng.choices("abc", (8, 2, 1))[0], la))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    want = {i: int(rate + 1e-9) + (spark_draw(i, rows[i][1]) < (rate + 1e-9) % 1) for i, (_, _, rate) in brute_rates(rows).items()}
    got = dict(corpus_pipeline.STAGES)["mixing"](spark, df, "")
    assert Counter(r.doc_id for r in got.collect()) == +Counter(want)


def test_pipeline_drops_near_copies(spark):
    words = [f"w{i}" for i in range(300)]
    edited = ["other" if i % 75 == 40 else w for i, w in enumerate(words)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(edited))], "doc_id long, text string")
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, df, "").collect()] == [0]
