"""The words that a worker keeps, and texts put together from them."""

from quarry.llm import duck_bpe


def test_words_in_use_are_encoded_once():
    data, pattern = duck_bpe.public_ranks()
    codec = duck_bpe.Codec(data, pattern, max_words=6)
    encoded, contract = [], codec._contract
    codec._contract = lambda words, recursion: (encoded.extend(words), contract(words, recursion))
    long = "x" * 80
    for k in range(8):
        letters = chr(97 + k) * 3
        texts = [f"common{letters} é{letters}é common", "", f"{long} common\n"]
        for text, (ids, n, decoded) in zip(texts, codec.encode(texts), strict=True):
            assert decoded == text.encode()
            assert n == len(ids.split(",")) if text else (ids, n) == ("", 0)
    assert encoded.count(" common") == encoded.count(long) == 1
    assert len(codec.words) + len(codec.older) <= 2 * 6


def test_ids_are_in_order_whatever_the_number_of_words():
    import tiktoken

    data, pattern = duck_bpe.public_ranks()
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=duck_bpe.read_ranks(data), special_tokens={})
    texts = [" ".join(f"w{chr(97 + i % 26)}ing{chr(97 + i // 26 % 26)}tion" for i in range(k, k + 700)) for k in (0, 300, 650)]
    texts += ["ab" * 400 + " " + "th" * 31, "日本語 🙂🙂\t\n  x"]
    assert [i for i, _, _ in duck_bpe.Codec(data, pattern).encode(texts)] == \
        [",".join(map(str, lib.encode_ordinary(t))) for t in texts]
