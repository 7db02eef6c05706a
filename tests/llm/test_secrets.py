import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import documents, edge_rows  # noqa: F401

from hitlens.llm import secrets


def brute(text):
    """Base spans by the definition, match by match."""
    found = []
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    patterns = ((0, assign, 2, 6), (1, re.compile("AKIA[A-Z0-9]+"), 0, 20), (2, re.compile("[0-9a-f]+"), 0, 24))
    for kind, pattern, group, least in patterns:
        at = 0
        while match := pattern.search(text, at):
            at = match.end()
            if len(match[group]) >= least:
                found.append((match.start(), kind, match.end()))
    return [(start, secrets.KINDS[kind], end) for start, kind, end in sorted(found)]


PIECES = st.sampled_from(
    ["password", "Token", "API_KEY", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12", "ab12cd34", "x", "\n", "é"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join))
def test_base_spans(text):
    assert [span for span in secrets.find_spans(text) if span[1] != "guess"] == brute(text)


def test_guesses_are_cheap_for_known_parts():
    cheap = ["password123", "changeme", "qwertyuiop", "aaaaaaaaaaaa", "abcabcabcabc", "1987-04-12", "Summer2024", "P@ssw0rd", "123456789"]
    dear = ["x9#Kq2!vLp0Z", "tR7$wq;9zN@4", "kjw8-vqpz-1mx0-q7"]
    assert max(map(secrets.guess_bits, cheap)) < secrets.MIN_BITS < min(map(secrets.guess_bits, dear))
    assert secrets.guess_bits("") == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1!qwe@", max_size=9))
def test_never_dearer_than_brute_force(value):
    assert secrets.guess_bits(value) <= sum(map(secrets.char_bits, value)) + 1e-9


def test_added_spans_do_not_touch_base_ones():
    text = 'pwd: "x9#Kq2!vLp0Z" and token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" password: changeme-please'
    spans = secrets.find_spans(text)
    assert [kind for _, kind, _ in spans] == ["guess", "assign", "hex", "assign"]
    assert text[spans[0][0] : spans[0][2]] == "x9#Kq2!vLp0Z"


def test_long_values_are_priced_whole():
    text = "secret_key: '" + "a#9" * 5000 + "'"
    assert secrets.find_spans(text) == []  # a repeat is cheap, however long


def test_scan(documents, edge_rows):
    rows = [*edge_rows, (99, "x password=hunter22 AKIA" + "Z" * 16)]
    got = secrets.scan(documents(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[99].n_assign, by_id[99].n_access, by_id[99].n_hex) == (1, 1, 0)
    assert by_id[99].spans == "assign:2:19,access:20:40"
    assert by_id[99].base_sha256 == hashlib.sha256(b"assign:2:19,access:20:40").hexdigest()
    assert by_id[0].base_sha256 == hashlib.sha256(b"").hexdigest() and by_id[0].spans == ""


def test_values_that_a_base_span_only_touches():
    text = "password: Tr0ub4dor&3#xyZ!9 and Authorization: Bearer x9Kq2vLp0Z~tR7w bearer token: kjw8!vqpz!1mx0 token=abcdef"
    got = [(kind, text[start:end]) for start, kind, end in secrets.find_spans(text)]
    assert got == [
        ("assign", "password: Tr0ub4dor"),
        ("guess", "Tr0ub4dor&3#xyZ!9"),
        ("guess", "x9Kq2vLp0Z~tR7w"),
        ("guess", "kjw8!vqpz!1mx0"),
        ("assign", "token=abcdef"),
    ]
    assert secrets.find_spans("auth: Bearer x9Kq2vLp0Z~tR7w")[0][1] == "guess"
    assert len(secrets.find_spans("bearer: x9Kq2vLp0Z~tR7w")) == 1
