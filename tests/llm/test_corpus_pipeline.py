import zlib

import numpy as np
from conftest import SMALL
from test_mixing import filled
from test_near import brute

import corpus_pipeline
from hitlens.llm import decontaminate, quality
from hitlens.llm.common import table
from hitlens.llm.queries import vocabulary_path


def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = table(spark, SMALL, "documents")
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs, before = spark.read.parquet(str(tmp_path / str(k))), docs
        assert docs.columns == before.columns
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    good = {r.doc_id for r in quality.scores(table(spark, SMALL, "documents"), table(spark, SMALL, "labels")).where("predicted = 1").collect()}
    assert set(kept[0]) == good and len(kept[0]) == len(good)
    left = {key for key, (_, _, stays) in brute([(key, rows[key][0]) for key in good]).items() if stays}
    assert set(kept[1]) == left and len(kept[1]) == len(left)
    items = [r.text for r in table(spark, SMALL, "benchmark").collect()]
    cores = lambda text: [c for c in (decontaminate.canonical(w)[0] for w in (text or "").split()) if c]
    windows = {tuple(c[k : k + 13]) for c in map(cores, items) for k in range(len(c) - 12)}
    clean = {key for key in left if not any(tuple(c[k : k + 13]) in windows for c in [cores(rows[key][0])] for k in range(len(c) - 12))}
    assert set(kept[2]) == clean and clean < left
    sizes = {}
    for key in clean:
        sizes[rows[key][1]] = sizes.get(rows[key][1], 0) + len((rows[key][0] or "").encode().split())
    for source, target in filled(sizes).items():
        words = [len((rows[key][0] or "").encode().split()) for key in kept[3] if rows[key][1] == source]
        longest = max(len((rows[key][0] or "").encode().split()) for key in clean if rows[key][1] == source)
        assert abs(sum(words) - target) <= longest
    tokenizer, start = Tokenizer.from_file(vocabulary_path()), 0
    got = corpus_pipeline.run(spark, SMALL).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(kept[3])
    for row in got:
        ids = [*tokenizer.encode(rows[row.doc_id][0] or "", add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
