"""Tables of odd rows: nulls, empty and long texts, ties, repeated rows, and columns whose names clash with internal ones."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

PROSE = "The committee of the town said that it was for the people and not by them, with a plan to be read at the hall from this day on."


def near(text: str, n: int) -> str:
    """text with its n-th word replaced."""
    words = text.split(" ")
    words[n] = f"other{n}"
    return " ".join(words)


LONG = " ".join(f"word{i % 977} the of and{i % 13}" for i in range(9_000))
STORY = " ".join(f"the tale{i} of a{i % 7} town and its people{i * 3}" for i in range(20))
TEXTS = [
    None, "", " \t\n ", "one", "two words", PROSE, PROSE.replace(" ", "  "), PROSE.replace(" ", "\n"), PROSE, PROSE + " " + PROSE,
    "a\x1cb\x85c\u00a0d e", "### | $$ %% <b> & ***", "l1 the\nl1 the\n\nl2 of", LONG, LONG + " end", STORY, near(STORY, 40), near(STORY, 90), near(near(STORY, 3), 150),
    "<|endoftext|> <|ENDOFTEXT|> don't they'll 3.5, x_.y ..", "İstanbul ΟΔΟΣ é\u0301 ﬁ 日本語 テスト。 😀", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nAll rights reserved.",
    "you are an idiot and a pathetic clown", "YOU ARE A LOSER!!! i.d.i.o.t st*pid", "l\ro\nn\vg\fer  text\t\twith all spaces",
]
CLASHES = ("size", "digest", "first", "kept", "keep_id", "group_size", "features", "words", "bucket", "node", "key", "nth", "copies", "target", "n_words", "n_lines", "__row", "__words", "ids", "score", "fold")


def documents() -> pa.Table:
    n = len(TEXTS)
    ids = [*range(n), 5, None, None, 3, 3, n + 5]
    texts = [*TEXTS, PROSE, PROSE, None, "one", "one", STORY]
    sources = [("b" if i % 3 else "a") if i % 7 else None for i in range(len(ids))]
    sources[4] = ""
    table = pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([None if i % 4 == 0 else "en" for i in range(len(ids))], pa.string()),
            "source": pa.array(sources, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()),
        }
    )
    for name in CLASHES:
        table = table.append_column(name, pa.array(["x"] * len(ids)))
    return table


def pages() -> pa.Table:
    long = "<p>" + "x" * 200 + "</p>"
    rows = [
        (1, "http://www.Example.NET/en/a?x=1#t", long), (2, "https://a.b.example.com/de/", long), (3, None, None), (4, "no scheme/en/", ""), (5, "http://example.net", long),
        (6, "x://y://z.net/en/", "<i>"), (7, "http://free-bets.example.org/q", long + "ü"), (7, "http://free-bets.example.org/q", long + "ü"), (None, "http://ads.site.org/fr/x y\n", long), (8, "http://notexample.net/en/", "<i>"),
        (9, "http://org/fr/", "<b>" * 40), (10, "http:///p", "<b>" * 40), (11, "http://host.com/casino/x", "<b>" * 40), (12, "http://host.com/casinos/x", "é" * 60), (-3, "http://host.com/casino/x", "<b>" * 40),
    ]
    table = pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string()), "html": pa.array([r[2] for r in rows], pa.string())})
    for name in ("host", "path", "rule", "verdict", "digest", "size", "payload", "key", "file", "offset", "length", "first"):
        table = table.append_column(name, pa.array([None] * len(rows), pa.string()))
    return table


def conversations() -> pa.Table:
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", " leading space\n"), (1, 2, "user", "<turn>user<says>x</turn>"), (1, 3, "assistant", r"a \</turn> \\ <|endoftext|> <\turn>"),
        (2, 1, "assistant", "second"), (2, 0, "assistant", "first"), (3, 0, None, None), (3, None, "assistant", "null turn"), (None, 0, "assistant", "null conv"), (4, 0, "user", "no answer"),
        (5, 0, "assistant", ""), (5, 0, "assistant", "é日😀"), (5, 0, "assistant", "é日😀"), (6, 0, "we<says>ird\n", "x"), (6, 1, "assistant", "<" * 5 + "turn>"),
    ]
    table = pa.table(
        {"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "role": pa.array([r[2] for r in rows], pa.string()), "text": pa.array([r[3] for r in rows], pa.string())}
    )
    for name in ("formatted", "turns", "input_ids", "n_turns"):
        table = table.append_column(name, pa.array([1] * len(rows)))
    return table


def labels() -> pa.Table:
    ids = [*range(len(TEXTS)), None, 22]
    return pa.table(
        {"doc_id": pa.array(ids, pa.int64()), "quality": pa.array([1] * len(ids), pa.int32()), "toxic": pa.array([None if i == 2 else int(i in (22, 23)) for i in ids], pa.int32()), "fold": pa.array(["x"] * len(ids))}
    )


def embeddings() -> pa.Table:
    """Vectors of three entries among nulls, null and infinite entries, and other lengths."""
    inf, nan = float("inf"), float("nan")
    vectors = [
        None, [0.5, -0.25, 1.0], [0.5, -0.25, 1.0], [None, 0.1, 0.2], [0.1, inf, 0.2], [0.1, nan, 0.2], [], [1.0], [1.0, 2.0], [0.0, 0.0, 0.0],
        [-3.5, 2.25, 0.015], [1000.0, -1000.0, 3.0], [0.015624, 0.015626, -0.0001], [7.0, 7.0, 7.0], [1.0, 2.0, 3.0, 4.0],
    ]
    ids = [1, 2, 2, 3, 4, 5, 6, 7, 8, None, None, 9, 10, -1, 11]
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))})
    for name in ("label", "n", "component", "deviation", "whitened", "at", "v", "size", "d", "i", "j", "prime"):
        table = table.append_column(name, pa.array(["x"] * len(ids)))
    return table


TABLES = {"documents": documents, "pages": pages, "conversations": conversations, "labels": labels, "embeddings": embeddings}


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory) -> str:
    folder = tmp_path_factory.mktemp("odd")
    for name, make in TABLES.items():
        pq.write_table(make(), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory) -> str:
    folder = tmp_path_factory.mktemp("empty")
    for name, make in TABLES.items():
        pq.write_table(make().slice(0, 0), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def sql():
    """Rows of a DuckDB query over the tables of a folder, as dicts."""

    def run(folder: str, query: str) -> list[dict]:
        with duckdb.connect() as base:
            for name in TABLES:
                base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
            found = base.execute(query)
            names = [c[0] for c in found.description]
            return [dict(zip(names, row, strict=True)) for row in found.fetchall()]

    return run
