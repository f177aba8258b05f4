"""Column functions on domain names and other short strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stats

#: Second-level labels under which two-letter country domains register names.
COUNTRY_SECONDS = ["co", "com", "net", "org", "gov", "ac", "edu", "nic", "res", "gen", "ind", "mil"]
#: Suffixes and names that are not worth lexical analysis.
NON_LEXICAL = r"(\.arpa|\.local|\.localhost|\.lan|\.home|\.internal)\.?$"
#: Shares of the fifty commonest English letter pairs.
ENGLISH_PAIRS = {
    "th": 0.0356, "he": 0.0307, "in": 0.0243, "er": 0.0205, "an": 0.0199, "on": 0.0176, "en": 0.0145, "at": 0.014, "es": 0.0132, "ed": 0.0131,
    "or": 0.0128, "ti": 0.0127, "is": 0.0113, "it": 0.0112, "al": 0.0109, "ar": 0.0107, "st": 0.0105, "to": 0.0104, "nt": 0.0104, "ng": 0.0095,
    "se": 0.0093, "ha": 0.0093, "ou": 0.0087, "io": 0.0083, "le": 0.0083, "nd": 0.0082, "re": 0.0081, "ea": 0.0069, "de": 0.0069, "co": 0.0068,
    "te": 0.0067, "of": 0.0067, "ra": 0.0062, "ri": 0.0062, "ne": 0.0058, "me": 0.0057, "sa": 0.0056, "li": 0.0054, "la": 0.0054, "el": 0.0053,
    "ve": 0.0052, "ta": 0.0051, "ce": 0.0049, "si": 0.0048, "ic": 0.0045, "no": 0.0044, "ma": 0.0044, "di": 0.0043, "ro": 0.0043, "as": 0.0042,
}
RARE_PAIR = 0.0001
NAME_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789-."
ENCODED_LENGTH = 128


def labels(name: Column) -> Column:
    """The non-empty labels of a name in lower case."""
    return F.filter(F.split(F.rtrim(F.lower(F.trim(name)), F.lit(".")), r"\."), lambda p: p != "")


def base_domain(name: Column) -> Column:
    """The last two labels, or three under a country's second-level label."""
    p = labels(name)
    n = F.size(p)
    three = (n > 2) & (F.length(F.element_at(p, -1)) == 2) & F.element_at(p, F.when(n > 1, -2).otherwise(-1)).isin(COUNTRY_SECONDS)
    take = F.least(n, F.when(three, 3).otherwise(2))
    return F.when(n == 0, "").otherwise(F.array_join(F.slice(p, n - take + 1, take), "."))


def second_level(name: Column) -> Column:
    return F.substring_index(F.lower(name), ".", -2)


def is_lexical(name: Column) -> Column:
    """False for local and reverse names and those under four characters."""
    return ~F.lower(name).rlike(NON_LEXICAL) & (F.length(name) >= 4)


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def pieces(s: Column, n: int) -> Column:
    """All substrings of n characters."""
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def entropy_of(values: Column) -> Column:
    """Shannon entropy, in bits, of the values of an array; 0 if it is empty."""
    return stats.frequencies(values)["bits"]


def char_entropy(s: Column) -> Column:
    return entropy_of(characters(s))


def bigram_entropy(s: Column) -> Column:
    return entropy_of(pieces(s, 2))


def char_ratio(s: Column, characters_class: str) -> Column:
    """Share of the characters in a class such as [0-9]; 0 for the empty string."""
    return F.when(F.length(s) == 0, 0.0).otherwise(F.regexp_count(s, F.lit(characters_class)) / F.length(s))


def max_repeat(s: Column) -> Column:
    """Length of the longest run of one character."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, c: Column) -> Column:
        run = F.when(a["last"] == c, a["run"] + 1).otherwise(1)
        return F.struct(c.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(characters(s), start, step, lambda a: a["best"])


def longest_label(name: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(name, r"\."), lambda p: F.length(p))), F.lit(0))


def dns_lexical(name: Column) -> dict[str, Column]:
    """24 features of a name; null where the name is empty."""
    whole = F.nullif(F.rtrim(F.lower(F.trim(name)), F.lit(".")), F.lit(""))
    parts = F.split(whole, r"\.")
    n = F.size(parts)
    part = F.when(n > 1, F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), ".")).otherwise(whole)
    sizes = F.transform(parts, lambda p: F.length(p))
    unique = F.size(F.array_distinct(characters(part)))
    length = F.length(part)
    bits = char_entropy(part)
    out = {
        "dns_bigram_entropy": bigram_entropy(part),
        "dns_digit_ratio": char_ratio(part, "[0-9]"),
        "dns_entropy": bits,
        "dns_hex_ratio": char_ratio(part, "[0-9a-f]"),
        "dns_len": length,
        "dns_log_len": F.log1p(length),
        "dns_longest_token": longest_label(whole),
        "dns_lower_ratio": char_ratio(part, "[a-z]"),
        "dns_max_repeat": max_repeat(part),
        "dns_norm_entropy": F.when(unique > 1, bits / F.log2(unique.cast("double"))).otherwise(0.0),
        "dns_special_ratio": char_ratio(part, "[._-]"),
        "dns_unique_chars": unique,
        "dns_unique_ratio": unique / F.greatest(length, F.lit(1)),
        "dns_vowel_ratio": char_ratio(part, "[aeiou]"),
        "entropy": char_entropy(whole),
        "fqdn_count": n,
        "labels_average": F.aggregate(sizes, F.lit(0), lambda a, x: a + x) / F.greatest(n, F.lit(1)),
        "labels_max": F.array_max(sizes),
        "len": F.length(whole),
        "lower": F.regexp_count(whole, F.lit("[a-z]")),
        "numeric": F.regexp_count(whole, F.lit("[0-9]")),
        "special": F.regexp_count(whole, F.lit("[._-]")),
        "subdomain": F.greatest(n - 2, F.lit(0)),
        "subdomain_length": F.when(n > 1, length).otherwise(0),
    }
    return {k: F.when(whole.isNotNull(), v) for k, v in out.items()}


def domain_stats(name: Column) -> dict[str, Column]:
    """Seven statistics of a name, scaled to about 0 to 1."""
    low = F.lower(F.trim(name))
    parts = F.split(low, r"\.")
    n = F.size(parts)
    inner = F.slice(parts, 1, F.greatest(n - 2, F.lit(1)))  # all but the last two labels, or the first of two
    part = F.array_join(inner, ".")
    pairs = pieces(part, 2)
    table = F.create_map(*[F.lit(x) for p in ENGLISH_PAIRS.items() for x in p])
    logs = F.aggregate(F.transform(pairs, lambda p: F.log(F.coalesce(table[p], F.lit(RARE_PAIR)))), F.lit(0.0), lambda a, x: a + x)
    english = F.when(F.size(pairs) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (logs / F.size(pairs) + 9.0) / 6.0)))
    alpha = F.regexp_count(part, F.lit("[a-z]"))
    return {
        "entropy": char_entropy(part) / 5.0,
        "bigram_score": english,
        "subdomains": F.least(F.greatest(n - 2, F.lit(0)) / 6.0, F.lit(1.0)),
        "consonant_ratio": F.when(alpha == 0, 0.0).otherwise(F.regexp_count(part, F.lit("[b-df-hj-np-tv-z]")) / alpha),
        "length": F.least(F.length(low) / 253.0, F.lit(1.0)),
        "digit_ratio": char_ratio(part, "[0-9]"),
        "max_label": F.least(F.array_max(F.transform(inner, lambda p: F.length(p))) / 63.0, F.lit(1.0)),
    }


def encode_chars(name: Column, length: int = ENCODED_LENGTH) -> Column:
    """Numbers of a name's characters: 0 pads, 1 stands for an unknown one."""
    codes = F.transform(F.slice(characters(F.lower(F.trim(name))), 1, length), lambda c: F.when(F.instr(F.lit(NAME_CHARACTERS), c) > 0, F.instr(F.lit(NAME_CHARACTERS), c) + 1).otherwise(1))
    return F.slice(F.concat(codes, F.array_repeat(F.lit(0), length)), 1, length)


def utc_offset_seconds(tz: Column) -> Column:
    """Seconds of an offset written as +05:30, -4 or a number of seconds."""
    sign = F.when(tz.startswith("-"), -1).otherwise(1)
    h, m = F.regexp_extract(tz, r"^[+-]?(\d{1,2})(?::(\d{2}))?$", 1), F.regexp_extract(tz, r"^[+-]?(\d{1,2})(?::(\d{2}))?$", 2)
    hours = F.coalesce(F.nullif(h, F.lit("")).cast("int"), F.lit(0)) * 3600 + F.coalesce(F.nullif(m, F.lit("")).cast("int"), F.lit(0)) * 60
    return F.when(tz.rlike(r"^[+-]?\d{1,2}(:\d{2})?$"), sign * hours).otherwise(tz.try_cast("int"))


def local_hour(ts: Column, offset: Column) -> Column:
    return F.floor((ts + offset) / 3600).cast("long")


#: TLS numbers reserved so that peers ignore unknown ones (RFC 8701).
GREASE = [0x0A0A + 0x1010 * i for i in range(16)]


def _plain(numbers: Column) -> Column:
    return F.filter(numbers, lambda x: ~x.isin(GREASE))


def _dashed(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), "-")


def ja3_string(version: Column, ciphers: Column, extensions: Column, groups: Column, formats: Column) -> Column:
    return F.concat_ws(",", version.cast("string"), _dashed(_plain(ciphers)), _dashed(_plain(extensions)), _dashed(_plain(groups)), _dashed(formats))


def ja3(*parts: Column) -> Column:
    return F.md5(ja3_string(*parts).cast("binary"))


def ja3s(version: Column, cipher: Column, extensions: Column) -> Column:
    return F.md5(F.concat_ws(",", version.cast("string"), cipher.cast("string"), _dashed(extensions)).cast("binary"))


def _hex4(numbers: Column) -> Column:
    return F.transform(numbers, lambda x: F.lower(F.lpad(F.hex(x), 4, "0")))


def _short_hash(text: Column) -> Column:
    return F.when(text == "", "000000000000").otherwise(F.substring(F.sha2(text.cast("binary"), 256), 1, 12))


def ja4(transport: Column, versions: Column, sni: Column, ciphers: Column, extensions: Column, alpn: Column, sig_algs: Column) -> Column:
    """JA4 client fingerprint; transport is q for QUIC and t for TCP."""
    names = F.create_map(*[F.lit(x) for p in {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3"}.items() for x in p])
    version = F.coalesce(names[F.array_max(_plain(versions))], F.lit("00"))
    c, e = _plain(ciphers), _plain(extensions)
    first = F.get(alpn, F.lit(0))
    code = F.when(first.isNull() | (first == ""), "00").otherwise(F.concat(F.substring(first, 1, 1), F.substring(first, -1, 1)))
    count = lambda a: F.lpad(F.least(F.size(a), F.lit(99)).cast("string"), 2, "0")
    a = F.concat(transport, version, F.when(sni.isNull(), "i").otherwise("d"), count(c), count(e), code)
    b = _short_hash(F.array_join(F.sort_array(_hex4(c)), ","))
    kept = F.array_join(F.sort_array(_hex4(F.filter(e, lambda x: ~x.isin(0x0000, 0x0010)))), ",")
    signed = F.array_join(_hex4(_plain(sig_algs)), ",")
    d = F.when(kept == "", "000000000000").otherwise(_short_hash(F.when(signed == "", kept).otherwise(F.concat(kept, F.lit("_"), signed))))
    return F.concat_ws("_", a, b, d)
