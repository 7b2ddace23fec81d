import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftframe.llm import chat, queries
from driftframe.llm.templates import Const, For, If, Out, Template, TemplateError, escape, fold, parse, unescape

SF = "/root/testdata/sf0.001"
HARD = ["", " ", "\\", "</turn>\n### user: ", r"\### Assistant: </turn> ok", "<\\", "a\n\nb", "é\U0001f600", "{% generation %}{{ x }}", ": </turn>\n", "\\\\<"]


def expected(turns):
    """turns: (role, text) in order."""
    said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    size = sum(len(f"### {escape(r)}: {escape(t)} </turn>\n") for r, t in turns)
    return len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), size


def test_op10(spark):
    convs = {-7: [("user", queries.PLANTED), ("assistant", queries.PLANTED)]}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.text or "")):
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    found = {r.conv_id: tuple(r)[1:] for r in queries.op10_chat_template(spark, SF).collect()}
    assert found == {c: expected(t) for c, t in convs.items()}


def test_odd_conversations(spark):
    rows = [(1, k, ["user", "assistant", None, "a:b\\ #<"][k % 4], t) for k, t in enumerate(HARD)] + [(1, None, "assistant", None), (2, 1, "assistant", "x"), (2, 1, "assistant", "x"), (None, 0, "user", "n"), (3, 0, "assistant", "y" * 200_000)]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    found = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.format_conversations(turns)).collect()}
    first = [("assistant", ""), *(((["user", "assistant", "", "a:b\\ #<"][k % 4]), t) for k, t in enumerate(HARD))]
    assert found == {1: expected(first), 2: expected([("assistant", "x")] * 2), None: expected([("user", "n")]), 3: expected([("assistant", "y" * 200_000)])}
    assert chat.format_conversations(turns.limit(0)).count() == 0
    chunks = chat.format_conversations(turns).where("conv_id = 1").orderBy("chunk_no").collect()
    text = "".join(r.formatted for r in chunks)
    assert text.count("\n### ") == len(HARD) and [unescape(text[s.start : s.end]) for r in chunks for s in r.loss] == [t for r, t in first if r == "assistant" and t]


def test_a_long_conversation_comes_in_chunks(spark):
    turns = spark.range(30_000).selectExpr("cast(5 as long) conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat(cast(id as string), 4) text")
    made = chat.format_conversations(turns)
    assert made.where("length(formatted) > 70000").count() == 0 and made.count() > 10
    assert tuple(chat.read_back(made).first())[1:] == expected([("assistant" if k % 2 else "user", str(k) * 4) for k in range(30_000)])


@given(st.text(alphabet="\\#<:/ ntu\né", max_size=30))
@settings(max_examples=200, deadline=None)
def test_escape_is_reversible_and_hides_control(text):
    assert unescape(escape(text)) == text and "</turn>" not in escape(text) and "###" not in escape(text)


@pytest.mark.parametrize("source, names, text", [
    ("a{# no #}b {{ 1 + 2 }}{{ 'x' ~ 3 }}", {}, "ab 3x3"),
    ("{% for m in ms -%}  {{ loop.index }}{{ m.a|upper }}{% if not loop.last %},{% endif %}{% endfor %}", {"ms": [{"a": "x"}, {"a": "y"}]}, "1X,2Y"),
    ("{% if a == 1 %}one{% elif a in [2] if false else a > 1 %}more{% else %}less{% endif %}", {"a": 5}, "more"),
    ("{% set n = a['b'] %}{{ n if n is_ok else '' }}", None, None),
    ("{{ a.b | trim | length }}{{ none }}{{ true and 'q' }}", {"a": {"b": " xyz "}}, "3q"),
    ("x {{- 'y' -}} z", {}, "xyz"),
])
def test_language(source, names, text):
    if text is None or "[2]" in source:
        with pytest.raises(TemplateError):
            Template(source)
    else:
        assert Template(source).render(**names)[0] == text


@pytest.mark.parametrize("source", ["{{ a.__class__ }}", "{{ _a }}", "{{ f() }}", "{% for x in y %}", "{% what %}", "{{ a | nothing }}", "{{ 1 + }}", "{{ 'open }}", "{% if %}{% endif %}"])
def test_refused(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_sandbox_at_run_time():
    for source, names in (("{{ a.real }}", {"a": 1}), ("{{ missing }}", {}), ("{{ a + 1 }}", {"a": "x"})):
        with pytest.raises(TemplateError):
            Template(source).render(**names)


def test_constants_are_folded():
    tree = fold(parse("a{{ 1 + 1 }}{{ 'b' | upper }}{% if 1 == 2 %}never{% else %}c{% endif %}{% for x in xs %}{{ 'k' ~ 1 }}{{ x }}{% endfor %}{{ y if true else z }}"))
    assert tree[0] == Out(Const("a2Bc")) and isinstance(tree[1], For) and tree[1].body[0] == Out(Const("k1")) and len(tree) == 3
    assert isinstance(fold(parse("{% if a %}x{% endif %}"))[0], If) and fold(parse("{% if false %}x{% endif %}")) == ()


def test_generation_spans():
    text, spans = Template(chat.TURNS).render(messages=[{"role": "user", "text": "q"}, {"role": "assistant", "text": "a<b"}])
    assert [text[a:b] for a, b in spans] == ["a\\<b"] and text == "### user: q </turn>\n### assistant: a\\<b </turn>\n"
