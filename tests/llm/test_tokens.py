import random

import public_tokenizers
import sentencepiece
from fixtures import frame, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from pactline.llm import token_transducer as tt

FILE = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=FILE)
T = tt.Transducer.from_model(FILE)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdehilnorstu  \n\t▁é漢😀ß.,<s>0'\x00"), max_size=60), st.integers(1, 9))
def test_count_equals_the_library_for_any_chunks(text, chunk):
    assert tt.count_tokens(T, text) == tt.count_tokens(T, text, chunk) == len(SP.encode(text))


def test_runs_of_spaces():
    for k in range(70):
        for end in ("", "the", "漢", "\n"):
            assert tt.count_tokens(T, " " * k + end, 7) == len(SP.encode(" " * k + end))


def test_prefix_scan_gives_every_prefix():
    r = random.Random(1)
    s = tt.MARK + prose(r, 60).replace(" ", tt.MARK)
    maps = [tt.chunk_map(T, s[i:i + 11]) for i in range(0, len(s), 11)]
    for k, m in enumerate(tt.prefix_scan(T, maps)):
        assert T.walk(T.fresh, m.head)[1] + m.inner == T.segments(s[:11 * (k + 1)])


def test_table(llm_spark):
    r = random.Random(6)
    rows = [(i, prose(r, r.randrange(300)), "en", "s", 1) for i in range(20)] + odd_rows()
    got = tt.token_counts(frame(llm_spark, rows), FILE, chunk=1000).collect()
    want = [(i, len((x or "").encode()), len(SP.encode(x or "")), len(SP.encode(x or "")) > 4096) for i, x, *_ in rows]
    assert sorted(map(tuple, got)) == sorted(want)
    assert tt.token_counts(frame(llm_spark, []), FILE).count() == 0
