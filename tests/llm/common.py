"""Tables with the awkward cases, and generators of plain text."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: The columns that operators use inside, as further columns of the input.
CLASHING = "id long, node long, label int, lost string, kept string, fw_id long, fw_text string, fw_row string, key string, h1 long, score double, anchor long, decoded string"

WORDS = "river stone garden window summer letter market bridge winter silver forest planet engine story candle harbor meadow pencil mirror basket".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def docs(spark, rows, extra=False):
    """documents from (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    if not extra:
        return spark.createDataFrame(full, DOCS)
    return spark.createDataFrame([(*f, 1, 2, 3, "x", "y", 4, "z", "w", "k", 5, 0.5, 6, "d") for f in full], f"{DOCS}, {CLASHING}")


def rows(df, *columns):
    found = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in found), key=repr)
