import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from leaselake.llm import bpe

from .conftest import DOCS, awkward_rows, lines
from .test_jaccard import edited, survivors
from .test_pii import plain_spans


def test_stages_in_order(spark, folder, awkward, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "encoding"]
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, "")
        assert docs.columns == awkward.columns, name
        assert stage(spark, empty, "").columns == empty.columns
        assert stage(spark, empty, "").count() == 0
        if name == "personal_data":
            assert docs.count() == before.count()
    assert corpus_pipeline.encoding(spark, empty, "").count() == 0


def test_run_against_plain_python(spark, folder):
    """All stages on a small corpus: what stays, masked and encoded, is what plain Python gives."""
    rows = [(i, lines(i // 2 if i % 10 == 1 else i + 500, 6) + f" mail u{i}@x.example.com", "en", f"src{i % 7}", 9) for i in range(60)]
    rows += [(70 + i, edited(i, rows[i][1], share), "en", "src2", 9) for i, share in enumerate([0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.2, 0.3])]
    rows += [(90, "123 456", "en", "src1", 7), (91, None, "en", "src1", 0)]
    path = folder("pipeline", documents=spark.createDataFrame(rows, DOCS))
    got = corpus_pipeline.run(spark, path).collect()
    live = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    least = {key for _, key in survivors(live)}
    kept = {r[0]: r[1] for r in live if r[0] in least}
    assert len(kept) <= len(live) - 2
    encoder = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)))},
    )
    want = {}
    for key, text in kept.items():
        spans = plain_spans(text)
        for k, s, e in spans[::-1]:
            text = text[:s] + "[EMAIL]" + text[e:]
        ids = encoder.encode_ordinary(text)
        digest = hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        want[key] = (len(ids), digest, hashlib.sha256(text.encode()).hexdigest())
    # The mixture drops or repeats whole documents; every one it keeps is right.
    assert {r.doc_id for r in got} <= set(want) and len(got) >= 0.8 * len(want)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in got)
