"""The corpus pipeline as a whole: every stage against a brute-force version on that stage's own input."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_llm_dups import fingerprint, jaccard
from test_llm_models import size, water_targets
from tokenizers import Tokenizer

import corpus_pipeline
from lexaria.llm import lines, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_pipeline_stages(spark, prose, reach, tmp_path, monkeypatch):
    near = prose[0][1].split(" ")
    docs = [(d, t, "en", f"s{i % 3}" if i % 11 else None, i) for i, (d, t) in enumerate(prose) if t is None or len(t) < 2000]
    docs += [(None, prose[200 % len(prose)][1], "en", "s1", 900 + i) for i in range(4)] + [(None, None, "en", "s1", 910)]
    docs += [(None, " ".join([*near, f"tail{i}"]), "de", "s2", 920 + i) for i in range(4)] + [(2, prose[30][1], "en", "s0", 930)]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.table(list(map(list, zip(*docs))), schema=schema), tmp_path / "documents.parquet")
    marks = [(d, int(d % 5 > 0)) for d in range(120)]
    pq.write_table(pa.table({"doc_id": [d for d, _ in marks], "quality": pa.array([q for _, q in marks], pa.int32())}), tmp_path / "labels.parquet")

    stored, store = [], corpus_pipeline.store
    monkeypatch.setattr(corpus_pipeline, "store", lambda df, name: stored.append(store(df, name)) or stored[-1])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(stored) == len(corpus_pipeline.STAGES) - 1 == 4 and all(df.columns == COLUMNS for df in stored)
    good, lined, alone, mixed = map(rows_of, stored)

    # the vote is held against brute force in test_quality; here: exactly its good rows pass, whole
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    judged = quality.classify(table, spark.read.parquet(str(tmp_path / "labels.parquet")), out="_q").select("*", F.col("_q.predicted").alias("p"))
    assert Counter(good) == Counter(tuple(r[c] for c in COLUMNS) for r in judged.collect() if r["p"] == 1)
    assert sum(r[0] is None for r in good) > 1

    # line dedup
    first = {}
    for d, t, *_ in good:
        for k, x in enumerate(map(lines.normal, (t or "").split("\n"))):
            if x:
                first[x] = min(first.get(x, (True, float("inf"), 0)), (d is None, d or 0, k))
    names = sorted(first)
    root = reach([(a, b) for i, a in enumerate(names) for b in names[i + 1:] if jaccard(a, b) >= lines.THRESHOLD], names)
    best = {}
    for x in names:
        best[root[x]] = min(best.get(root[x], first[x]), first[x])
    want = Counter()
    for d, t, *rest in good:
        if d is not None:
            raw = [(r, lines.normal(r), k) for k, r in enumerate((t or "").split("\n"))]
            left = [r for r, x, k in raw if not x or best[root[x]] == (False, d, k)]
            if any(map(lines.normal, left)) or not any(x for _, x, _ in raw):
                want[(d, None if t is None else "\n".join(left), *rest)] += 1
    assert Counter(r for r in lined if r[0] is not None) == want
    stays = Counter(root[x] for d, t, *_ in lined if d is None for x in map(lines.normal, (t or "").split("\n")) if x)
    assert stays and stays == Counter(c for c, b in best.items() if b[0])

    # near-duplicate documents
    fps = sorted({fingerprint(r[1]) for r in lined})
    root = reach([(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if bin(a ^ b).count("1") <= 3], fps)
    rank = lambda r: (r[0] is None, r[0] or 0)
    least = {}
    for r in lined:
        c = root[fingerprint(r[1])]
        least[c] = min(least.get(c, rank(r)), rank(r))
    assert sorted((root[fingerprint(r[1])], rank(r)) for r in alone) == sorted(least.items()) and not Counter(alone) - Counter(lined)

    # source mix
    words = Counter()
    for r in alone:
        words[r[3]] += size(r[1])
    taken, most = Counter(), max(size(r[1]) for r in alone)
    for r in mixed:
        taken[r[3]] += size(r[1])
    assert set(mixed) <= set(alone)
    for s, target in water_targets(words).items():
        assert target - most <= taken[s] <= target + 1e-6

    # packing
    lib, ids = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), Counter()
    for d, t, *_ in mixed:
        full = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert len(full) <= 2048
        ids[(d, 0, 0, len(full), zlib.crc32(np.array(full, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == ids
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq in by.values():
        ends = [o + n for o, n in sorted(seq)]
        assert [o for o, _ in sorted(seq)] == [0, *ends[:-1]] and ends[-1] <= 2048
