"""URL expressions and image URLs."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(c: Column, safe: str = "/") -> Column:
    """Percent-encoded UTF-8; letters, digits, `_.-~` and `safe` stay (a blank becomes %20)."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for mark in {"~", *safe} - set("*"):
        code = quote(mark, safe="")
        if code != mark or mark == "~":
            out = F.replace(out, F.lit("%7E" if mark == "~" else code), F.lit(mark))
    return out if "*" in safe else F.replace(out, F.lit("*"), F.lit("%2A"))


def host_matches(url: Column, host: str) -> Column:
    """Whether a URL's host is `host` or a part of it."""
    found = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce((found == host.lower()) | F.endswith(found, F.lit("." + host.lower())), F.lit(False))


def query_value(url: Column, key: str) -> Column:
    """A decoded query parameter, null if absent."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(key)))


def joined(base: str, path: Column) -> Column:
    """An absolute URL: `path` itself if it has a scheme, else below `base`."""
    return F.when(path.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, "^/+", "")))


def fits(width: Column, height: Column | None, largest: int) -> Column:
    """Whether known sizes are within a limit; by the width alone if there is no height column."""
    sizes = width if height is None else F.when(width.isNotNull() & height.isNotNull(), F.greatest(width, height))
    return F.coalesce(sizes <= largest, F.lit(False))


def iiif_url(service: Column, width: Column, height: Column | None, largest: int, full: str = "max", template: str = "!{size},{size}", quality: str = "default", kind: str = "jpg") -> Column:
    """An image service's URL: full size if it fits, else resized."""
    size = F.when(fits(width, height, largest), F.lit(full)).otherwise(F.lit(template.format(size=largest)))
    return F.concat(F.regexp_replace(service, "/+$", ""), F.lit("/full/"), size, F.lit(f"/0/{quality}.{kind}"))


def delivery_url(base: str, identifier: Column, width: Column, height: Column, largest: int) -> Column:
    """A delivery service's URL, with a size limit if the image doesn't fit."""
    url = F.concat(F.lit(base + "?id="), quoted(identifier, ":/"))
    return F.when(fits(width, height, largest), url).otherwise(F.concat(url, F.lit(f"&max={largest}")))


def thumbnail_url(base: str, name: Column, width: Column, largest: int, safe: str = ";@$!*(),~:") -> Column:
    """A URL under the two md5 folders of a file name, of the file if its width fits or is unknown, else of its thumbnail."""
    digest, file = F.md5(name), quoted(name, safe)
    path = F.concat(F.substring(digest, 1, 1), F.lit("/"), F.substring(digest, 1, 2), F.lit("/"), file)
    thumb = F.concat(F.lit(base + "/thumb/"), path, F.lit(f"/{largest}px-"), file)
    return F.when(width.isNull() | (width <= largest), F.concat(F.lit(base + "/"), path)).otherwise(thumb)
