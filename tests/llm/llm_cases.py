"""Fixtures of the training-data operators: edge-case documents and the driver's small tables."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, `row` int, digest string, `count` int, size string, n_words string"

EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "Same Text here"), (7, "same text HERE"), (8, "same text here"),
    (8, "same text here"), (None, "same text here"), (None, None), (9, "É same text here"), (10, "é same text here"), (11, "x" * 300_000),
    (12, "long words here \n" * 20_000), (13, "a b c d e f g h i j"), (13, "a b c d e f g h i j"), (14, "#*$%&|<> !"),
]


def edge_rows():
    return [(i, t, None if k % 5 == 0 else "en", (None, "a", "b")[k % 3], None, "k", 7, "d", 3, "s", "w") for k, (i, t) in enumerate(EDGE)]


def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def small_docs(spark, sf="0.001"):
    return spark.read.parquet(f"{tiny(sf)}/documents.parquet")


def tiny(sf="0.001"):
    return f"/root/testdata/sf{sf}"


def pairs(df):
    """(doc_id, text) of a documents table, as a list."""
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def groups_by_link(items, linked):
    """Connected groups of a small list under a symmetric test, by brute force."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(items))]
