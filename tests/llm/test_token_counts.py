import random

import public_tokenizers

from casemill.llm import token_counts as t

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, start, inner, end=b""):
    word, at, n = word + end, 0, 0
    while at < len(word):
        pieces = inner if at else start
        for stop in range(len(word), at, -1):
            if word[at:stop] in pieces:
                at, n = stop, n + 1
                break
        else:
            return 0
    return n


def split(pieces):
    inner = {p[2:] for p in pieces if p.startswith(b"##") and len(p) > 2}
    return {p for p in pieces if not (p.startswith(b"##") and len(p) > 2)}, inner


def test_random_vocabularies():
    rnd = random.Random(1)
    letters = lambda low, high: bytes(rnd.choice(b"ab") for _ in range(rnd.randint(low, high)))
    for _ in range(200):
        pieces = {(b"##" if rnd.random() < 0.6 else b"") + letters(1, 5) for _ in range(rnd.randint(1, 8))}
        for end in (b"", b"\xff"):
            own = pieces | ({rnd.choice((b"##", b"b")) + b"\xff"} if end else set())
            automaton = t.PieceAutomaton(own, end)
            for _ in range(30):
                word = letters(1, 9)
                assert automaton.count(word) == greedy(word, *split(own), end), (own, word)


def test_word_piece_library():
    from tokenizers import Tokenizer, models

    names = ["[UNK]", "un", "##aff", "##able", "##a", "##b", "a", "##ff", "able", "u", "##n"]
    model = Tokenizer(models.WordPiece({n: i for i, n in enumerate(names)}, unk_token="[UNK]", max_input_chars_per_word=1000))
    automaton = t.PieceAutomaton(n.encode() for n in names[1:])
    for word in ("unaffable", "unaff", "aab", "able", "xyz", "unx", "aaffb", "unaffableb"):
        tokens = model.encode(word).tokens
        assert automaton.count(word.encode()) == (0 if tokens == ["[UNK]"] else len(tokens))


def test_documents(spark):
    long = "word " * 50_000
    texts = [None, "", " \t\n", "The cats sat", "the CATS sat", long, "x" * 5000, "é\x1cü", "the cats sat"]
    docs = spark.createDataFrame([(i % 8, x, 9) for i, x in enumerate(texts)], "doc_id int, text string, n_tokens int")
    found = t.token_counts(docs, PATH).collect()
    assert len(found) == len(texts)
    start = inner = set(t.byte_level_pieces(PATH))
    for row, text in zip(found, texts):
        words = (text or "").replace("\x1c", "\x1c").split(" ") if text == long else [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        words = [w for w in words if w]
        sample = {w: greedy(w.lower().encode() if w.isascii() else w.encode(), start, inner, t.END_MARK) for w in set(words)}
        assert row.n_words == len(words) and row.n_tokens == sum(max(sample[w], 1) for w in words) and row.n_unknown == 0
    assert t.token_counts(docs.limit(0), PATH).count() == 0


def test_number_signs_are_ordinary_pieces_of_a_byte_level_vocabulary():
    import json

    vocabulary = json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]
    # These characters stand for themselves in the file.
    entries = {e.removesuffix("</w>").encode() + (t.END_MARK if e.endswith("</w>") else b"") for e in vocabulary if e.isascii()}
    assert b"##" + t.END_MARK in entries
    automaton = t._automaton(PATH)
    for word in (b"##", b"###", b"####", b"a##", b"##a", b"#", b"x##y##", b"##" * 50):
        assert automaton.count(word) == greedy(word, entries, entries, t.END_MARK), word
    assert automaton.count(b"##") == 1
