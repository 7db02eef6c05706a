"""URI expressions with the results of Python's ``urllib.parse``.

Everything here is a built-in Spark expression, so the work stays inside the
JVM. Rare inputs (escapes, control characters, ``;params``) sit behind a cheap
``contains``/``rlike`` test, so ordinary rows never pay for them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes whose last path segment may carry ";params"
# (the list in Python's urllib.parse, the empty scheme included below).
PARAM_SCHEMES = (
    "ftp hdl prospero http imap https shttp rtsp rtsps rtspu sip sips mms sftp tel"
).split()

SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*:"
NETLOC = rf"^(?:{SCHEME})?//([^/?#]*)"
PATH = rf"^(?:{SCHEME})?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
PAIR_WITH_VALUE = r"(?:^|&)([^=&]*=[^&]+)"
TAKES_PARAMS = rf"^(?!{SCHEME})|^(?i:{'|'.join(PARAM_SCHEMES)}):"

UNKNOWN_DOMAIN = "Unknown"


def _percent_decode(text: Column) -> Column:
    # A lone "%" would make url_decode fail; Python leaves it as it is.
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def decode_uri(uri: Column) -> Column:
    """Percent-decode; ``+`` and bad escapes stay, bad UTF-8 becomes U+FFFD."""
    kept_plus = F.replace(uri, F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(uri, F.lit("%")), _percent_decode(kept_plus)).otherwise(uri)


def without_controls(uri: Column) -> Column:
    """Leading blanks and controls, and any tab, CR or LF, are not part of a URL."""
    stripped = F.translate(F.regexp_replace(uri, r"^[\x00-\x20]+", ""), "\t\r\n", "")
    return F.when(uri.rlike(r"[\x00-\x20]"), stripped).otherwise(uri)


# Parts of a URI that has passed ``without_controls``. They are small steps so
# that a caller can keep each one in a column and evaluate it once.


def path_part(uri: Column) -> Column:
    return F.regexp_extract(uri, PATH, 1)


def query_part(uri: Column) -> Column:
    return F.regexp_extract(uri, QUERY, 1)


def netloc_part(uri: Column) -> Column:
    return F.regexp_extract(uri, NETLOC, 1)


def strip_params(path: Column, uri: Column) -> Column:
    has_params = F.contains(path, F.lit(";")) & uri.rlike(TAKES_PARAMS)
    return F.when(has_params, F.regexp_replace(path, r";[^/]*\z", "")).otherwise(path)


def split_query(query: Column) -> Column:
    pairs = F.regexp_extract_all(query, F.lit(PAIR_WITH_VALUE), F.lit(1))
    # "+" means a space here, so url_decode applies as it is. Decoding each
    # pair after the split keeps a decoded "&" or "=" inside its value.
    decoded = F.transform(pairs, _percent_decode)
    return (
        F.when(query.isNull() | (query == ""), F.array().cast("array<string>"))
        .when(query.rlike("[%+]"), decoded)
        .otherwise(pairs)
    )


def name_domain(netloc: Column) -> Column:
    return F.when(netloc.isin("", "-") | netloc.isNull(), UNKNOWN_DOMAIN).otherwise(netloc)


def uri_path(uri: Column) -> Column:
    """Path of a (decoded) URI, without ``;params`` on its last segment."""
    clean = without_controls(uri)
    return strip_params(path_part(clean), clean)


def uri_query_pairs(uri: Column) -> Column:
    """``k=v`` pairs of the query part: blank values dropped, both sides decoded."""
    return split_query(query_part(without_controls(uri)))


def referer_domain(referer: Column) -> Column:
    """Network location of the referer, case, port and user kept, else ``Unknown``."""
    return name_domain(netloc_part(without_controls(referer)))
