import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from fixtures import frame, odd_rows, prose
from tokenizers import Tokenizer

from pactline.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_force(texts):
    """Figures of each text, by walking both token lists."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    model = sentencepiece.SentencePieceProcessor(model_file=B)

    def piece_bytes(i):
        p = model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()

    groups, counts = [], Counter()
    for x in texts:
        mine = []
        if x:
            a = [(i, bytes(byte_of[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + x, add_special_tokens=False).ids]
            b = [(i, piece_bytes(i)) for i in model.encode(x)]
            want = b" " + x.encode()
            if b"".join(t for _, t in a) == want == b"".join(t for _, t in b):
                i = j = end_a = end_b = 0
                ga, gb = [], []
                while i < len(a) or j < len(b):
                    if end_a <= end_b:
                        ga.append(a[i][0])
                        end_a += len(a[i][1])
                        i += 1
                    else:
                        gb.append(b[j][0])
                        end_b += len(b[j][1])
                        j += 1
                    if end_a == end_b and ga and gb:
                        mine.append((ga, gb))
                        ga, gb = [], []
        groups.append(mine)
        counts.update({(p, q) for ga, gb in mine for p in ga for q in gb})
    most = Counter()
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    out = []
    for mine in groups:
        links = [(p, q) for ga, gb in mine for p in ga for q in gb]
        spelled = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in mine)
        out.append((sum(len(g) for g, _ in mine), sum(len(g) for _, g in mine), len(mine), len(links), sum(counts[x] == most[x[0]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(spelled.encode()).hexdigest() if mine else "", spelled))
    return out


def documents():
    r = random.Random(8)
    odd = ["a<|endoftext|>b </s> <s> <0x41>", "has ▁ in it", "漢字かな交じり文 😀😀 ñandú", "a" * 3000, "=" * 777 + "x", " leading", "trailing  ", "tab\tline\n\n\r\nend", "\x00\x01", "०१२", "e\u0301\u00a0x"]
    odd += ["".join(r.choice("ab é漢\n=1_") for _ in range(r.randrange(1, 400))) for _ in range(60)]
    rows = [(i, x, "en", "s", len(x)) for i, x in enumerate([*odd, *(prose(r, 80, 300) for _ in range(40))])]
    return [*rows, *odd_rows(), (None, "no id", "en", "s", 5), *[(500 + k, "one copied text of many", "en", "s", 23) for k in range(50)]]


def test_alignment_equals_a_walk_over_both_token_lists(llm_spark):
    rows = documents()
    want = Counter((row[0], *f) for row, f in zip(rows, by_force([row[1] for row in rows]), strict=True))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    for more in ({}, {"block_tokens": 500, "step_bytes": 300}):
        got = ta.align_documents(frame(llm_spark, rows).repartition(3), A, B, spell=True, **more)
        assert Counter(tuple(r[n] for n in names) for r in got.collect()) == want


def test_wide_groups_keep_their_multiplicities(monkeypatch):
    own = ta.aligner(A, B)
    texts = [x[1] for x in documents()]
    plain = own.align(texts).links().sort_by([("doc", "ascending"), ("pair", "ascending")])
    monkeypatch.setattr(ta, "WIDE", 0)
    assert own.align(texts).links().sort_by([("doc", "ascending"), ("pair", "ascending")]).equals(plain)


def test_empty_table(llm_spark):
    assert ta.align_documents(frame(llm_spark, []), A, B).count() == 0
