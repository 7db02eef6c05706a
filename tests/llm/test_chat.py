import pytest

from llm_fixtures import prose  # noqa: F401

from hitlens.llm import chat
from hitlens.llm.queries import CONTROL_TEXT

SCHEMA = "conv_id long, turn long, role string, text string"


def read(rows, windows):
    """Turns and targets by conversation from the windows' texts, with plain Python."""

    def plain(text, codes):
        for letter, code in reversed(codes):
            text = text.replace(code, letter)
        return text

    found = {}
    for row in sorted(windows, key=lambda r: r.span):
        turns = [piece.removeprefix(chat.OPEN).partition("\n") for piece in row.text.split(chat.CLOSE)[:-1]]
        turns = [(plain(role, chat.ROLE_ESCAPES), plain(text, chat.ESCAPES)) for role, _, text in turns]
        told, targets = found.setdefault(row.conv_id, ([], []))
        told += turns[len(turns) - row.own :]
        targets += [plain(row.text[m.begin : m.begin + m.length], chat.ESCAPES) for m in row.loss]
    return found


def test_turns_come_back(spark, prose):
    rows = []
    for conv in range(12):
        if conv % 3 == 0:
            rows.append((conv, 0, "system", prose(conv, 30)))
        rows += [(conv, k, ("user", "assistant")[k % 2], prose(conv * 99 + k, 5 + 37 * k % 300)) for k in range(1, 8 + 5 * conv)]
    hard = [CONTROL_TEXT, "\\b \\l \\h \\\\ < # </turn>\n### x", "", None, "\n\n", "\\"]
    rows += [(50, k, "assistant" if k % 2 else "ro\nle <#\\n", text) for k, text in enumerate(hard)]
    rows += [(51, 0, "user", "tie"), (51, 0, "user", "tie"), (51, None, "assistant", "last"), (None, 0, None, "nobody")]
    rows += [(52, 300 * k, "assistant", f"far {k}") for k in range(600)]
    windows = chat.windows(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    order = lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, (told, targets) in read(rows, windows).items():
        expected = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        assert told == expected
        assert targets == [text for role, text in expected if role == "assistant"]
    assert len({r.conv_id for r in windows}) == len({r[0] for r in rows})


def test_windows_keep_to_the_budget(spark, prose):
    rows = [(1, 0, "system", prose(0, 40))]
    rows += [(1, k, ("user", "assistant")[k % 2], prose(k, 10 + k * 7 % 90)) for k in range(1, 120)]
    rows += [(1, 120, "assistant", prose(1, 3000))]
    windows = sorted(chat.windows(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.span)
    assert len(windows) > 5
    assert all(r.tokens <= chat.BUDGET for r in windows[:-1])
    assert all(r.text.startswith("### system\n") for r in windows)
    repeated = [r.text.count(chat.CLOSE) - r.own for r in windows]
    assert repeated[0] == 0 and max(repeated) > 1
    assert sum(r.own for r in windows) == 121


def test_no_room():
    with pytest.raises(ValueError):
        chat.windows(None, budget=100, history=60, stride=50)


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)
    plan = chat.digests(chat.windows(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_turns_and_long_system_turns(spark, prose):
    rows, longest = [], {}
    for conv, system in enumerate((0, 30, 300, 500, 700, 900)):
        sizes = [40 + k * 53 % 90 for k in range(30)] + [513, 20, 700, 60, 1000, 80, 30]
        rows += [(conv, 0, "system", prose(conv, system))] * (system > 0)
        rows += [(conv, k + 1, ("user", "assistant")[k % 2], prose(conv + k, size)) for k, size in enumerate(sizes)]
        longest[conv] = system
    windows = chat.windows(spark.createDataFrame(rows, SCHEMA)).collect()
    for row in windows:
        own = row.text.split(chat.CLOSE)[-1 - row.own : -1]
        system = longest[row.conv_id]
        assert row.text.startswith("### system\n") or not system
        needed = len(own[0].split()) + (system + 2) * (system > 0)
        assert row.tokens <= max(chat.BUDGET, needed + 1 if row.own == 1 else 0)
    told = read(rows, windows)
    for conv in longest:
        assert told[conv][0] == [(r[2], r[3]) for r in rows if r[0] == conv]
