"""Stable identifiers and names derived from paths, remotes and contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_prefix(text: Column, size: int) -> Column:
    return F.left(F.sha2(text, 256), F.lit(size))


def number_text(value: Column) -> Column:
    """A whole number without decimals, others as they are."""
    value = value.cast("double")
    whole = value.cast("bigint")
    return F.when(value == whole, whole.cast("string")).otherwise(value.cast("string"))


def event_id(source_id: Column, seq: Column, content: Column) -> Column:
    """`evt_` and 32 hex digits over source, position and content."""
    key = F.concat(source_id, F.lit(":"), number_text(seq), F.lit(":"), content)
    return F.concat(F.lit("evt_"), sha_prefix(key, 32))


def source_id(locator: Column, device_id: str) -> Column:
    return F.concat(F.lit("src_"), sha_prefix(F.concat_ws(":", F.lit(device_id), locator), 32))


def _match(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def normal_remote(url: Column) -> Column:
    """Host and path of a remote, without scheme, user and `.git`."""
    ssh, web = r"^git@([^:]+):(.+?)(\.git)?$", r"^https?:\/\/([^/]+)\/(.+?)(\.git)?$"

    def parts(pattern: str) -> Column:
        return F.concat(_match(url, pattern, 1), F.lit("/"), _match(url, pattern, 2))

    return F.coalesce(parts(ssh), parts(web), url)


def display_name(remote: Column, root_path: Column) -> Column:
    """Last part of the remote, or of the root path without one."""

    def last(text: Column, back: int) -> Column:
        return F.nullif(F.try_element_at(F.split(text, "/"), F.lit(-back)), F.lit(""))

    remote = F.nullif(remote, F.lit(""))
    of_remote = F.coalesce(last(remote, 1), last(remote, 2), remote)
    return F.when(remote.isNotNull(), of_remote).otherwise(F.coalesce(last(root_path, 1), root_path))


def project_id(remote: Column, root_path: Column) -> Column:
    """Readable prefix of up to twenty characters and a hash of remote or path."""
    slug = F.regexp_replace(F.lower(display_name(remote, root_path)), r"[^a-z0-9]", "-")
    slug = F.left(F.regexp_replace(slug, r"-+", "-"), F.lit(20))
    identity = F.coalesce(F.nullif(remote, F.lit("")), root_path)
    return F.concat(slug, F.lit("-"), sha_prefix(identity, 16))


def session_of_path(path: Column) -> Column:
    return _match(path, r"(?i)([a-f0-9-]+)\.jsonl$", 1)


def project_hash_of_path(path: Column) -> Column:
    return _match(path, r"projects/([^/]+)/", 1)


def decoded_directory(name: Column) -> Column:
    """`-a-b` or `a-b` as `/a/b`."""
    return F.concat(F.lit("/"), F.translate(F.regexp_replace(name, "^-", ""), "-", "/"))
