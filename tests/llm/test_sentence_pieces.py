import random

from tallyloom.llm import sentence_pieces as S
from tallyloom.llm.queries import tokenizer

PATH = tokenizer("piece_bpe_32k.model")


def plain(text):
    """The best segmentation of the whole text by trying every piece at every place."""
    import sentencepiece

    if not text:
        return []
    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    scores = {m.id_to_piece(i): (m.get_score(i), i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
    byte = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(m.get_piece_size()) if m.is_byte(i)}
    longest, lowest = max(map(len, scores)), min(s for s, _ in scores.values())
    chars = ["▁", *("▁" if c == " " else "literal" if c == "▁" else c for c in text)]
    best = [(0.0, [])]
    for end in range(1, len(chars) + 1):
        options = []
        for size in range(1, min(longest, end) + 1):
            piece = "".join(chars[end - size : end])
            if "literal" not in chars[end - size : end] and piece in scores:
                own, i = scores[piece]
                options.append((best[end - size][0] + own, size, best[end - size][1] + [i]))
        if not options:
            raw = "▁" if chars[end - 1] == "literal" else chars[end - 1]
            options = [(best[end - 1][0] + lowest + S.PENALTY, 1, best[end - 1][1] + [byte[b] for b in raw.encode()])]
        top = max(options, key=lambda o: (o[0], o[1]))
        best.append((top[0], top[2]))
    return best[-1][1]


TEXTS = ["", "a", " ", "  ", " a", "a ", "a  b   c ", "the house\nof x\t1", "▁", "a▁b ▁▁ c", "日本語 字", "😀😀 x", "﷐ y", "éé", "\u0000z"]


def test_best_segmentation_of_whole_texts():
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abehtnos  é#▁\n1") for _ in range(40)) for _ in range(60)]
    for text, ids in zip(texts, S.encoded(PATH, texts)):
        assert ids.tolist() == plain(text), repr(text)


def test_round_trip():
    rng = random.Random(3)
    texts = TEXTS + ["".join(chr(rng.choice([32, 32, 97, 101, 10, 0x2581, 0x301, 0x4E2D, 0x1F600, rng.randrange(1, 0xD7FF)])) for _ in range(80)) for _ in range(200)]
    model = S.pieces(PATH)
    for text, ids in zip(texts, S.encoded(PATH, texts)):
        assert model.decode(ids.tolist()) == text


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = S.sentence_pieces(docs, PATH).collect()
    assert len(rows) == docs.count() and all(r["round_trip"] and r["n_pieces"] == len(r["pieces"]) for r in rows)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (None, "x y", 0), (3, "long " * 30000, 0)], "doc_id long, text string, pieces int")
    out = {r["doc_id"]: r for r in S.sentence_pieces(df, PATH).collect()}
    assert out[1]["pieces"] == out[2]["pieces"] == [] and out[3]["round_trip"] and out[None]["n_pieces"] == len(plain("x y"))
    assert S.sentence_pieces(df.limit(0), PATH).collect() == []
