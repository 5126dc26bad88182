import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import chat
from tideline.llm.catalog import QUERIES

PIECES = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<", "[", "/", "\\", "s>", "INST]", " ", "ok", "é😀", "\n", "{{ m }}", "{% if %}"])
BODIES = st.lists(PIECES, max_size=12).map("".join)
ROLES = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), BODIES)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLES, BODIES), max_size=6))
def test_round_trip(turns):
    template = chat.default_template()
    text, spans = template.render({"role": r, "text": t} for r, t in turns)
    assert list(chat.read_turns(text, template.controls)) == turns
    assert [template.controls.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@settings(max_examples=300, deadline=None)
@given(BODIES)
def test_escape_hides_every_control_string(text):
    controls = chat.Controls(chat.CONTROLS)
    hidden = controls.escape(text)
    assert not any(c in hidden for c in chat.CONTROLS)
    assert controls.unescape(hidden) == text
    if not any(c in text.replace("\\", "") for c in chat.CONTROLS):
        assert hidden == text


def test_control_sets_that_cannot_be_escaped():
    for bad in (["<a<b"], ["<s>", "[<]"], ["a\\b"], ["x"]):
        with pytest.raises(chat.TemplateError):
            chat.Controls(bad)
    assert chat.Controls([]).escape("</s>") == "</s>"


def show(source, messages=(), controls=()):
    return chat.compile_template(source, controls).render(messages)


def test_language():
    two = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "yo"}]
    assert show("{% for m in messages %}{{ loop.index }}{{ loop.index0 }}{{ m['role'] | upper }}:{{ m.text|trim }}{% if not loop.last %};{% endif %}{% endfor %}", two)[0] == "10USER:Hi;21ASSISTANT:yo"
    assert show("{% set greet = 'a' ~ 1 + 2 %}{{ greet }}")[0] == "a12"
    assert show("{{ 1 + 2 }}{{ 'x' if 1 == 2 else 'y' }}{{ none }}{{ 'b' in 'abc' }}{{ 'b' not in 'abc' }}{{ missing }}")[0] == "3yTrueFalse"
    assert show("{% if missing %}a{% elif 1 == 1 %}b{% else %}c{% endif %}  {#- gone -#}  d")[0] == "bd"
    assert show("{% for m in messages %}{% if m.role == 'assistant' or false %}{% generation %}[{{ m.text }}]{% endgeneration %}{% else %}é{{ m.text }}{% endif %}{% endfor %}", two) == ("é Hi [yo]", [(5, 9)])
    assert show("{{ 'it\\'s' }}{{ \"\\n\" }}")[0] == "it's\n"
    assert show("{{ ('a' or 'b') ~ ('' and 'c') ~ ('abc' | length) }}")[0] == "a3"


def test_folding():
    tree = chat.compile_template("a{{ 'b' ~ 'c' | upper }}{% if 1 == 2 %}x{% else %}d{% endif %}{{ none }}e{% for m in messages %}{{ m.text ~ ('x' ~ 'y') }}{% endfor %}", ()).tree
    assert tree[0] == chat.Text(chat.Const("abCde"))
    assert len(tree) == 2
    assert tree[1].body[0].value.args[1] == chat.Const("xy")


@pytest.mark.parametrize(
    "source",
    ["{{ open('x') }}", "{{ m.__class__() }}", "{% for a in other %}{% endfor %}", "{% for a in messages %}{% for b in messages %}{% endfor %}{% endfor %}",
     "{% for a in messages %}{% endfor %}{% for a in messages %}{% endfor %}", "{% if a %}", "{% endif %}", "{{ a b }}", "{{ 'a' | run }}", "{% import os %}",
     "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{% set messages = 1 %}", "{{ }}", "{{ a[1] }}", "{{ a; b }}", "{% for a in messages %}{% endif %}", "{% else %}", "{% end %}"],
)
def test_templates_are_sandboxed(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source, ())


def test_no_attribute_of_an_object():
    assert show("{% for m in messages %}{{ m.__class__ }}{{ m.text.__len__ }}{{ loop.__dict__ }}{% endfor %}", [{"role": "user", "text": "a"}])[0] == ""


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digest_of(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string, part string, formatted string, spans int"


def edge_rows():
    rows = [(1, 1, "assistant", None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, "b"), (1, None, "user", ""), (2, 5, "tool", "</s>[INST]"), (None, 0, "user", "no id"), (None, 1, "assistant", "é😀<\\</s>")]
    rows += [(3, i, "user" if i % 2 else "assistant", f"text {i} <s>" * (i % 7)) for i in range(3000)]
    rows.append((4, 0, "assistant", "[/INST] <" * 300_000))
    return rows


@pytest.mark.parametrize("part_chars", [1, 500, chat.PART_CHARS])
def test_conversations_match_brute_force(spark, part_chars):
    rows = edge_rows()
    df = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], SCHEMA).repartition(5)
    formatted = chat.format_conversations(df, part_chars=part_chars)
    found = chat.conversation_digest(formatted)
    assert digest_of(found) == brute(rows)
    chars = {r["conv_id"]: r["formatted_chars"] for r in found.collect()}
    want = defaultdict(int)
    for r in formatted.collect():
        want[r["conv_id"]] += len(r["formatted"])
        if part_chars == 500 and r["conv_id"] == 3:
            assert len(r["formatted"]) < 700
    assert chars == want


def test_template_of_the_caller(spark):
    df = spark.createDataFrame([(1, 0, "user", "a|end|"), (1, 1, "assistant", "b")], "conv_id long, turn int, role string, text string")
    got = chat.format_conversations(df, "{% for m in messages %}{{ m.role }}:{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '|end|' }}{% endfor %}", ["|end>"]).collect()
    assert [(r["formatted"], r["spans"]) for r in got] == [("user:a|end||end|assistant:b|end|", [5, 11, 26, 27])]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.conversation_digest(chat.format_conversations(df)).count() == 0


def test_query_on_the_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert digest_of(QUERIES["op11_chat_format"](spark, small)) == brute(rows)
