"""URL resolution, validity and keys.

Resolution follows RFC 3986 reference resolution with the ``;params`` of the
last path segment kept apart. It is staged as a chain of projections instead of
one nested expression, so that every part is computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlens.functions.staging import settle

# Schemes whose references resolve against a base address.
RELATIVE_SCHEMES = (
    "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp",
    "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_HOST = r"^//([^/?#]*)"
_PATH = r"^(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"(?s)^[^#]*#(.*)$"
_PARAMS = r";[^/]*$"
_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"


def is_absolute(url: Column) -> Column:
    """Scheme and host are both present. Never raises, NULL counts as false."""
    return F.coalesce(url.rlike(_ABSOLUTE), F.lit(False))


def host_of(url: Column) -> Column:
    """Host part (with port), '' when there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)


def seen_key(url: Column) -> Column:
    return F.sha2(url, 256)


def snapshot_key(url: Column) -> Column:
    return F.md5(url)


def posting_id(company: Column, url: Column) -> Column:
    return F.md5(F.concat(company, F.lit("|"), url))


def section_url(page_url: Column, title: Column) -> Column:
    """Address for a posting without a link of its own."""
    return F.concat(page_url, F.lit("#"), F.substring(F.md5(title), 1, 8))


def _rx(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, r'{pattern}', {group})"


def _drop(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, r'{pattern}', '')"


def _cleaned(text: str) -> str:
    """Without tabs and line ends, and without control characters in front."""
    return _drop(_drop(text, r"[\t\r\n]"), r"^[\x00-\x20]+")


def _part(mark: str, text: str) -> str:
    """Optional part of an address with its mark in front."""
    return f"if({text} != '', concat('{mark}', {text}), '')"


# Resolve '.' and '..' segments of an absolute path; others pass untouched.
_FOLDED = r"""
if(@m rlike r'(?:^|/)\.\.?(?:/|$)',
   coalesce(nullif(array_join(concat(
     aggregate(split(@m, '/'), cast(array() as array<string>), (acc, s) ->
       case s when '..' then slice(acc, 1, greatest(size(acc) - 1, 0)) when '.' then acc
       else concat(acc, array(s)) end),
     if(element_at(split(@m, '/'), -1) in ('.', '..'), array(''), cast(array() as array<string>))), '/'), ''), '/'),
   @m)"""


_RESERVED = "__u_"


def _sql(text: str) -> Column:
    """SQL in which ``@name`` stands for a stage column."""
    return F.expr(text.replace("@", _RESERVED))


def _staged(df: DataFrame, *stages: dict[str, str]) -> DataFrame:
    for stage in stages:
        df = df.select("*", *[_sql(sql).alias(_RESERVED + name) for name, sql in stage.items()])
    return df


def with_joined_url(df: DataFrame, href: str, base: str, out: str) -> DataFrame:
    """Add ``out``: ``href`` resolved against ``base``, fragment kept."""
    keep = [c for c in df.columns if c != out]
    schemes = ", ".join(f"'{s}'" for s in RELATIVE_SCHEMES)
    staged = _staged(
        df.select(*keep, F.col(href).alias(_RESERVED + "ref"), F.col(base).alias(_RESERVED + "b")),
        {
            "u": _cleaned("@ref"),
            "bs": f"lower({_rx('@b', _SCHEME)})", "br": _drop("@b", _SCHEME),
        },
        {
            "s": f"lower({_rx('@u', _SCHEME)})", "r": _drop("@u", _SCHEME),
            "bh": _rx("@br", _HOST), "bp": _rx("@br", _PATH), "bq": _rx("@br", _QUERY),
        },
        {
            "h": _rx("@r", _HOST), "pp": _rx("@r", _PATH), "q": _rx("@r", _QUERY), "f": _rx("@r", _FRAGMENT),
            "foreign": f"(@s != '' and @s != @bs) or @bs not in ({schemes})",
        },
        {
            # a bare ';' is no parameter
            "par": f"coalesce(nullif({_rx('@pp', _PARAMS, 0)}, ';'), '')", "p": _drop("@pp", _PARAMS),
            # directory of the base: everything up to its last slash
            "dir": _rx(_drop("@bp", _PARAMS), r"^(.*/)[^/]*$"),
        },
        # doubled slashes are folded only when base and reference are merged
        {"m": "if(startswith(@p, '/'), @p, regexp_replace(concat(if(@dir = '', '/', @dir), @p), '/{2,}', '/'))"},
        {
            "np": f"if(@p = '' and @par = '', @bp, concat({_FOLDED}, @par))",
            "nq": "if(@p = '' and @par = '' and @q = '', @bq, @q)",
        },
    )

    def assembled(host: str, path: str, query: str) -> str:
        rooted = f"if({path} != '' and not startswith({path}, '/'), concat('/', {path}), {path})"
        return f"concat(@bs, '://', {host}, {rooted}, {_part('?', query)}, {_part('#', '@f')})"

    result = f"""
      case when @ref is null or @b is null then null when @b = '' then @ref when @ref = '' then @b
        when @foreign then @ref when @h != '' then {assembled('@h', 'concat(@p, @par)', '@q')}
        else {assembled('@bh', '@np', '@nq')} end"""
    return settle(staged, keep, {out: _sql(result)})


def with_clean_url(df: DataFrame, href: str, base: str, out: str) -> DataFrame:
    """Keyword-scan form: absolute, no fragment, no params; NULL if not a web address."""
    keep = [c for c in df.columns if c != out]
    joined = with_joined_url(df, href, base, "__joined")
    staged = _staged(
        joined.select(*keep, F.col(href).alias(_RESERVED + "ref"), "__joined"),
        {"full": _cleaned("case when @ref rlike '^https?://' then @ref when startswith(@ref, '//') "
                          "then concat('https:', @ref) else __joined end")},
        {"s": f"lower({_rx('@full', _SCHEME)})", "r": _drop("@full", _SCHEME)},
        {"h": _rx("@r", _HOST), "p": _drop(_rx("@r", _PATH), _PARAMS), "q": _rx("@r", _QUERY)},
    )
    clean = f"if(@s != '' and @h != '', concat(@s, '://', @h, @p, {_part('?', '@q')}), null)"
    return settle(staged, keep, {out: _sql(clean)})


def with_record_url(df: DataFrame, href: str, base: str, out: str) -> DataFrame:
    """Site-record form: whatever starts with ``http`` is taken as it is, fragment kept."""
    keep = [c for c in df.columns if c != out]
    joined = with_joined_url(df, href, base, "__joined").select(*keep, F.col(href).alias(_RESERVED + "ref"), "__joined")
    full = ("case when @ref = '' then '' when startswith(@ref, 'http') then @ref "
            "when startswith(@ref, '//') then concat('https:', @ref) else __joined end")
    return settle(joined, keep, {out: _sql(full)})
