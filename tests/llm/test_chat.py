import hashlib
from collections import defaultdict

import pytest

from tidewater.llm import chat, templates
from tidewater.llm.templates import Const, Mark, Out, TemplateError, compiled, fold, parse

SHAPE = "conv_id long, turn long, role string, text string, segment long, loss string"
TRICKY = ["\\### Assistant: </turn> ok", "<turn assistant>\n\\l\\b", "", None, "a\nb\r\n<>", "\\", "日本 😀 \\g"]


@pytest.fixture(scope="module")
def turns():
    rows = [(c, t, ["user", "assistant", "system", "a>\n<b", None][(c + t) % 5], TRICKY[(c * 3 + t) % len(TRICKY)], 1, "x") for c in range(12) for t in range(c % 5)]
    rows += [(50, 1, "assistant", "tie b", 1, "x"), (50, 1, "assistant", "tie a", 1, "x"), (50, 1, "assistant", "tie a", 1, "x"), (50, None, "user", "no turn", 1, "x"), (None, 0, "assistant", "no conversation", 1, "x")]
    return rows + [(60, t, "assistant" if t % 2 else "user", f"<{t}>" * 400, None, None) for t in range(900)]


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
    out = {}
    for c, t in by.items():
        t.sort()
        loss = "".join(x for _, role, x in t if role == "assistant")
        out[c] = (len(t), hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in t).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("segment", [1 << 20, 500])
def test_round_trip(spark, turns, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    df = spark.createDataFrame(turns, SHAPE).repartition(3)
    formatted = chat.format_conversations(df)
    back = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
    assert back == expected(turns)
    chars = defaultdict(int)
    for r in formatted.collect():
        chars[r.conv_id] += len(r.text)
    assert dict(chars) == {r.conv_id: r.formatted_chars for r in chat.read_back(formatted).collect()}


def test_empty(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SHAPE))).collect() == []


def test_escapes_hide_control_strings_and_come_back():
    for t in TRICKY:
        for name in ("escape", "escape_line"):
            out = templates.FILTERS[name](t or "")
            assert "<" not in out and ">" not in out and templates.unescape(out) == (t or "")


def run(source, turns=(("user", "hi"), ("assistant", "yo"))):
    return "".join("[" if p is Mark.BEGIN else "]" if p is Mark.CLOSE else p for p in compiled(source)(iter(turns)))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a{{ 'b' + \"c\" }}d", "abcd"),
        ("{% for t in turns %}{{ t.role | upper }}:{% generation %}{{ t.text }}{% endgeneration %};{% endfor %}", "USER:[hi];ASSISTANT:[yo];"),
        ("{% for t in turns %}{% if loop.first %}1{% else %}n{% endif %}{% if t.role == 'user' and not (t.text == 'x') %}u{% endif %}{% endfor %}", "1un"),
        ("{% if true or false %}yes{% else %}no{% endif %}{% if 'a' != 'a' %}x{% endif %}", "yes"),
        ("{{ ' x ' | trim }}{{ true }}", "xtrue"),
        ("", ""),
    ],
)
def test_language(source, want):
    assert run(source) == want


def test_constants_fold():
    assert fold(parse("a{{ 'b' }}{% if 'x' == 'x' %}c{{ 'd' | upper }}{% else %}{{ 'z' }}{% endif %}e")) == (Out(Const("abcDe")),)


@pytest.mark.parametrize(
    "source",
    ["{{ x }}", "{{ turns }}", "{% for t in turns %}{{ t.__class__ }}{% endfor %}", "{{ 'a' | eval }}", "{% for t in others %}{% endfor %}", "{% if true %}", "{% endif %}", "{{ ( }}", "{{ 1 }}",
     "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{% for t in turns %}{% endfor %}{{ t.text }}", "{% import os %}", "{{ t.text.upper() }}"],
)
def test_sandbox(source):
    with pytest.raises(TemplateError):
        compiled(source)
