"""Tables with what real ones have: nulls, empty and long texts, ties, repeated rows, columns of clashing names."""

import random

#: Names that operators use inside, as columns of the input.
CLASHING = ["score", "predicted", "kept", "keep_id", "salt", "digest", "body", "block", "epoch", "tokens", "rep", "comp", "id", "mark", "bucket", "a", "t", "class_id", "n_tokens", "__order", "ids"]


def prose(rng: random.Random, n: int) -> str:
    syllables = "th er on in re an ti es or ha st en ed nd to it ou ea hi is".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed: int = 1, plain: int = 40) -> list[str | None]:
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(20, 150)) for _ in range(plain)]
    out += [None, None, "", "", " ", "\n", "A", "a", "one two three", "One Two Three"]
    base = prose(rng, 200)
    words = base.split()
    for k in range(6):  # near copies: one word of two hundred differs
        w = list(words)
        w[10 * k + 3] = f"changed{k}"
        out.append(" ".join(w))
    out += [base, base.upper(), base, "Der " * 300, "Der " * 301]
    shared = prose(rng, 30)
    out += [prose(rng, 20) + " " + shared + " " + prose(rng, 20) for _ in range(4)]
    out += ["é" * 60, "漢字かな交じり文。" * 12, "ÀÉÎ über straße ﬁ Ⅳ İstanbul ΣΑΣ 😀 x1²", "<|endoftext|> it's <|startoftext|>we'll", "tab\tnull\x00bell\x07", "no break  two", "x" * 5000]
    out.append(prose(rng, 30_000))  # a long text
    return out


def documents(spark, rows=None, extra: bool = True, ids=None):
    """Documents of ``texts``, some rows repeated, one with a null id."""
    ts = texts() if rows is None else rows
    data = [(i if ids is None else ids[i], t, ("en", "de", None)[i % 3], ("s0", "s0", "s1", None)[i % 4], len(t or "")) for i, t in enumerate(ts)]
    if rows is None:
        data += [data[0], data[0], data[3], (None, "text of a row without id " * 5, "en", "s0", 10)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    return df


def empty(spark):
    return documents(spark, []).limit(0)
