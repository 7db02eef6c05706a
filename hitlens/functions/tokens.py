"""Token arrays made from paths, query pairs and user agents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token classes, tested in this order.
TOKEN_CLASSES = (
    (r"^[a-fA-F0-9]{24}$", "MONGOID"),
    (r"^\d+$", "DIGIT"),
)


def characters(text: Column) -> Column:
    return F.split(text, "")


def path_tokens(path: Column) -> Column:
    """Segments between slashes; the blank before a leading slash is kept."""
    return F.split(path, "/")


def agent_tokens(agent: Column) -> Column:
    return F.split(agent, " ")


def pair_key(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def pair_value(pair: Column) -> Column:
    """Everything after the first ``=``."""
    return F.substr(pair, F.instr(pair, "=") + 1)


def query_keys(pairs: Column) -> Column:
    return F.transform(pairs, pair_key)


def query_values(pairs: Column) -> Column:
    return F.transform(pairs, pair_value)


def query_values_cut(pairs: Column) -> Column:
    """Older form: the value ends at a second ``=``; NULL where there is none."""
    return F.transform(pairs, lambda p: F.get(F.split(p, "="), F.lit(1)))


def url_tokens(path: Column, pairs: Column) -> Column:
    return F.concat(path_tokens(path), query_keys(pairs))


def classify_token(token: Column) -> Column:
    for pattern, name in TOKEN_CLASSES:
        token = F.regexp_replace(token, pattern, name)
    return token


def classify_tokens(tokens: Column) -> Column:
    return F.transform(tokens, classify_token)


def token_document(tokens: Column) -> Column:
    return F.concat_ws(" ", tokens)


def query_length(decoded_uri: Column, path: Column) -> Column:
    return F.length(decoded_uri) - F.length(path)
