"""Equal copies of a record multiply only where the result does."""

from quarry.llm import forms, pathjoin, queries

VARIANTS = [("v0", "a conta dos prazos da lei"), ("v1", "а conta dos prazos da lei"), ("v2", "A conta dos prazos, da lei"), ("v3", "outra coisa sem nada em comum")]


def joins(node):
    if node.getClass().getSimpleName() == "Join":
        yield node
    for i in range(node.children().size()):
        yield from joins(node.children().apply(i))


def compared(df):
    """Columns of the joins that compare rows of a group with each other."""
    found = [j for j in joins(df._jdf.queryExecution().optimizedPlan()) if any(sign in j.condition().toString() for sign in (" < ", "NOT "))]
    return [j.output().toString() for j in found]


def test_copies_of_one_text(make_docs, rows):
    items = [(f"c{i:02}", "a conta dos prazos da lei") for i in range(40)] + VARIANTS
    text = dict(items)
    form = {d: forms.rewriter()(t) for d, t in items}
    pairs = forms.same_looking_pairs(make_docs(items))
    assert rows(pairs) == sorted((a, b) for a in text for b in text if a < b and text[a] != text[b] and form[a] == form[b])
    met = compared(pairs)
    assert met and not any("doc_id" in m for m in met)


def test_copies_of_one_set(make_docs, rows):
    items = [(f"c{i:02}", "a conta dos prazos da lei") for i in range(40)] + VARIANTS
    form = {d: forms.rewriter()(t) for d, t in items}
    pairs = pathjoin.near_duplicate_pairs(make_docs(items))
    assert rows(pairs) == sorted((a, b) for a in form for b in form if a < b and form[a] != form[b] and "v3" not in (a, b))
    met = compared(pairs)
    assert met and not any("doc_id" in m for m in met)


def test_every_record_has_a_group(make_docs, rows, tmp_path):
    items = [("a", "um dois três quatro cinco seis"), ("b", "um dois tres quatro cinco seis"), ("s", "um dois"), ("t", "um dois"), ("e", ""), ("n", None), ("o", None, 2), ("o", "versão antiga", 1)]
    make_docs(items).write.parquet(f"{tmp_path}/docs.parquet")
    got = queries.queries()["p4_groups"](make_docs(items).sparkSession, str(tmp_path))
    assert rows(got, "doc_id", "group_id", "links") == [("a", "a", 0), ("b", "a", 0), ("e", "e", 0), ("s", "s", 0), ("t", "t", 0)]
