"""Small documents with every awkward case, and brute-force versions."""

import random

EXTRA = ["fp", "k", "k1", "_k1", "score", "runs", "component_id", "ids", "a", "row", "n", "h", "x.y", "_n_lines", "_n_removed",
         "_row", "_d", "_h", "_copies", "_runs", "_l"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def make_docs(spark, rows):
    """rows: (doc_id, text[, lang]) with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1]), *("z",) * len(EXTRA))
            for r in rows]
    return spark.createDataFrame(full, SCHEMA)


WORDS = "the and of er on ing reth ther ould wit hat non ble tion".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def awkward():
    """Nulls, empties, white space, very long texts, ties and repeated rows."""
    long = prose(1, 60_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, prose(4, 80)), (4, prose(4, 80)), (5, prose(4, 80)), (None, prose(6, 40)),
            (None, None), (7, long), (8, long), (9, "!!! 123 éé"), (10, "\U0001f642 日本語"),
            (11, "a" * 5000), (12, "\n".join([prose(9, 6)] * 5)), (13, prose(13, 30) + "\n\n\n\n\n" + prose(14, 30))]


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
