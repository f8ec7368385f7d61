"""Hash, compression, sequence and network functions."""

from .base import X, cast, fn, simple

simple("SHA1", "unhex(sha1({0}))", "BYTES")
simple("SHA256", "unhex(sha2({0}, 256))", "BYTES")
simple("SHA512", "unhex(sha2({0}, 512))", "BYTES")
simple("MD5", "unhex(md5({0}))", "BYTES")


def _udf(names, udf, out, least=1, most=None):
    fn(names, least, most)(lambda c, a: X(f"{c.udf(udf)}({', '.join(x.sql for x in a)})", out))


fn("FARM_FINGERPRINT", 1)(lambda c, a: X(f"{c.udf('fnv')}(cast({a[0].sql} as binary))", "INT64"))
fn("ZSTD_COMPRESS", 1, 2)(lambda c, a: X(f"{c.udf('zstd')}(cast({a[0].sql} as binary))", "BYTES"))
_udf("ZSTD_DECOMPRESS_TO_BYTES", "unzstd", "BYTES")
fn("ZSTD_DECOMPRESS_TO_STRING", 1, 2)(lambda c, a: X(f"cast({c.udf('unzstd')}({a[0].sql}) as string)", "STRING"))
fn("GET_NEXT_SEQUENCE_VALUE", 1)(lambda c, a: X(c.next_value(a[0].lit[0]), "INT64"))
fn("GET_INTERNAL_SEQUENCE_STATE", 1)(lambda c, a: X(c.sequence_state(a[0].lit[0]), "INT64"))


@fn("NET.HOST", 1)
def _host(c, a):
    u = f"trim({cast(a[0], 'STRING')})"
    whole = f"try_parse_url({u}, 'HOST')"
    return X(f"lower(IF(regexp_like({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://'), {whole}, try_parse_url(concat('http://', regexp_replace({u}, '^//', '')), 'HOST')))", "STRING")


simple("NET.REG_DOMAIN", "substring_index({0}, '.', -2)", "STRING")
simple("NET.PUBLIC_SUFFIX", "substring_index({0}, '.', -1)", "STRING")
_udf("NET.IP_FROM_STRING", "ip_from", "BYTES")
_udf("NET.SAFE_IP_FROM_STRING", "ip_from_safe", "BYTES")
_udf("NET.IP_TO_STRING", "ip_text", "STRING")
_udf("NET.IP_NET_MASK", "ip_mask", "BYTES", 2)
_udf("NET.IP_TRUNC", "ip_trunc", "BYTES", 2)
fn("NET.IPV4_FROM_INT64", 1)(lambda c, a: X(c.guard(f"{a[0].sql} < 0 OR {a[0].sql} > 4294967295", "no IPv4 address", f"unhex(lpad(hex({a[0].sql}), 8, '0'))"), "BYTES"))
fn("NET.IPV4_TO_INT64", 1)(lambda c, a: X(c.guard(f"octet_length({a[0].sql}) <> 4", "no IPv4 address", f"cast(conv(hex({a[0].sql}), 16, 10) as bigint)"), "INT64"))
