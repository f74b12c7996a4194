"""run() against a plain version of the five stages, on a small corpus with every odd case."""

import random
import zlib

import numpy as np
import public_tokenizers
from fixtures import frame, odd_rows
from test_classifiers import corpus
from test_lines import by_force as plain_lines
from test_near_dedup import by_force as plain_classes
from test_phrases import by_force as plain_phrases
from tokenizers import Tokenizer

import corpus_pipeline
from pactline.llm import line_spread
from pactline.llm import quality_ranking as qr


def test_run_equals_plain_stages(llm_spark, tmp_path):
    r = random.Random(12)
    docs, labels = corpus(r, 160)
    items = [(k, " ".join(f"q{k}x{j}" for j in range(30))) for k in range(4)]
    docs = [(i, x, lang, f"site{i % 15}", len(x)) for i, x, lang, _, _ in docs]
    for i, x, *_ in docs[:30]:  # near copies, benchmark passages and a line on every site
        docs.append((1000 + i, x + " tail", "en", f"site{i % 15}", 1))
        docs.append((2000 + i, x.replace(" ", " zz ", 1) + " " + items[i % 4][1][:r.choice([40, 120])], "en", f"site{i % 15}", 1))
        docs.append((3000 + i, f"all sites share this line\n{x[::-1]}", "en", f"site{i % 15}", 1))
    docs += odd_rows()
    sf = str(tmp_path)
    frame(llm_spark, docs, extra=False).write.parquet(f"{sf}/documents.parquet")
    llm_spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    llm_spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    model = qr.fit(llm_spark.read.parquet(f"{sf}/documents.parquet"), llm_spark.read.parquet(f"{sf}/labels.parquet"))
    good = [d for d in docs if model.scores(np.array([qr.text_features(d[1])]))[0] >= 0.7]
    lines = {(i, n): (t, g) for (i, t, _, g), n in zip(plain_lines(good, line_spread.MIN_SITES), range(len(good)))}
    cleaned = []
    for (i, _), (t, gone) in lines.items():
        if not gone or (t or "").strip(" "):
            cleaned.append((i, t, None, None, None))
    kept = {i for i, _, _, first in plain_classes(cleaned, 5, 80) if first}
    single = {(i, t): (i, t, None, None, None) for i, t, *_ in cleaned if i in kept}.values()
    bad = {(i) for i, n, hit, _ in plain_phrases(single, items) if hit and 20 * hit >= n}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t, *_ in single:
        if i not in bad:
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
            cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
            want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert bad and len(good) < len(docs) and len(single) < len(cleaned)
    got = corpus_pipeline.run(llm_spark, sf).collect()
    assert sorted((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_every_operator_is_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op") and k[2].isdigit()} and "pipeline" in names
