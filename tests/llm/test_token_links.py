"""Cross-tokenizer alignment against whole-text tokenisation by both libraries and plain loops."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest

from quandrel.llm import token_links
from quandrel.llm.token_links import MODEL_A, MODEL_B, ByteBpe, Pieces

ODD = ["a" * 3000, " " * 5000, "x\n\n  y \t z", "▁x y", "<|endoftext|> <s> </s>", "é à 😀😀 1234567 don't  we've", " lead", "trail ", "tail\n", "\nhead next", "a b c 　d"]
ODD += ["\x1c \x1d x \x85 y", "１２３ Ⅷ a\0b", "The cat " * 700, None, "", "中文 字符 test中文", "the cat", "the cat", "x" + " " * 1500 + "y z", "� é"]


class Whole:
    def __init__(self):
        self.a, self.b = ByteBpe(MODEL_A), Pieces(MODEL_B)

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.whole.encode(" " + text, add_special_tokens=False).ids, self.b.model.encode(text)
        sides = [[(i, self.a.tokens[i]) for i in a], [(i, self.b.tokens[i]) for i in b]]
        if any(b"".join(t for _, t in side) != (" " + text).encode() for side in sides):
            return []
        ends, spans = [], []
        for side in sides:
            at, spanned = 0, []
            for i, t in side:
                at += len(t)
                spanned.append((i, at))
            ends.append({e for _, e in spanned})
            spans.append(spanned)
        out, i, j = [], 0, 0
        for end in sorted(ends[0] & ends[1]):
            group = ([], [])
            while i < len(spans[0]) and spans[0][i][1] <= end:
                group[0].append(spans[0][i][0])
                i += 1
            while j < len(spans[1]) and spans[1][j][1] <= end:
                group[1].append(spans[1][j][0])
                j += 1
            out.append(group)
        return out


def brute(rows):
    tool, of = Whole(), []
    for _, text in rows:
        of.append(tool.groups(text))
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in of]
    docs = Counter(pair for c in links for pair in c)
    top = defaultdict(int)
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    out = []
    for (i, _), groups, c in zip(rows, of, links):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(n for (a, b), n in c.items() if docs[a, b] == top[a])
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), c.total(), best, sum(n * docs[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_odd_texts_and_repeated_ids(spark, few):
    rows = [*enumerate(ODD), (0, "the cat sat"), (None, "the cat"), (None, "the dog")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(token_links.link_tokens(docs, few_pairs=few)) == brute(rows)


def test_smallest_table(spark):
    rows = duckdb.connect().execute("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert found(token_links.op11_token_links(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_groups_of_many_ids_count_by_distinct_ids(spark, monkeypatch):
    rows = [(1, "aa 1111111 中文中文"), (2, "ééé 22222")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute(rows)
    monkeypatch.setattr(token_links, "EACH", 1)
    aligner = token_links.Aligner(ByteBpe(MODEL_A), Pieces(MODEL_B))
    columns = [c.to_pylist() for c in aligner.documents([t for _, t in rows])]
    assert [columns[3], columns[4]] == [[r[4] for r in want], [r[7] for r in want]]
    assert found(token_links.link_tokens(docs)) == want


def test_steps_cover_a_batch():
    import pyarrow as pa

    texts = pa.array(["x" * 700_000, None, "y" * 400_000, "", "z" * 3_000_000, "a", "b" * 1_048_576])
    assert token_links.steps(texts) == [(0, 2), (2, 4), (4, 5), (5, 6), (6, 7)] and token_links.steps(texts[:0]) == []


def test_columns_pass_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5, "y")], "doc_id int, text string, `a.b` string, link_a int, row string")
    got = token_links.link_tokens(docs)
    assert got.columns == ["doc_id", "a.b", "link_a", "row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(r)[:4] for r in got.collect()] == [(1, "x", 5, "y")]
    assert token_links.link_tokens(docs.limit(0)).collect() == []
