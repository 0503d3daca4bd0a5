"""Scalar column expressions: levels, angles, notes, sends, formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR_DB = -144.0


def lin_to_db(x: Column) -> Column:
    return F.when(x > 1e-12, 20 * F.log10(x)).otherwise(FLOOR_DB)


def pow_to_db(p: Column) -> Column:
    return F.when(p > 1e-24, 10 * F.log10(p)).otherwise(FLOOR_DB)


def gain_to_db(g: Column) -> Column:
    """Session volumes have a floor of their own."""
    return F.when(g > 0, 20 * F.log10(g)).otherwise(-150.0)


def db_to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def lufs(p: Column) -> Column:
    return F.when(p > 1e-24, -0.691 + 10 * F.log10(p)).otherwise(FLOOR_DB)


def rounded(x: Column, places: int = 6) -> Column:
    """Half away from zero after scaling, never minus zero; the same number in other engines."""
    scale = float(10**places)
    return F.round(x * scale) / scale + 0.0


def half_away(x: Column) -> Column:
    """The nearest whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def wrap_az(az: Column) -> Column:
    """Degrees in (-180, 180]."""
    turned = F.pmod(az, F.lit(360.0))
    return F.when(turned > 180, turned - 360).otherwise(turned)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def direction(az: Column, el: Column) -> tuple[Column, Column, Column]:
    """Right, front, up of an azimuth that is positive to the left; degrees."""
    flat = F.cos(F.radians(el))
    return -flat * F.sin(F.radians(az)), flat * F.cos(F.radians(az)), F.sin(F.radians(el))


def azimuth(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(-x, y))


def elevation(x: Column, y: Column, z: Column) -> Column:
    return F.degrees(F.atan2(z, F.hypot(x, y)))


def adm_to_room(az: Column, el: Column, dist: Column) -> tuple[Column, Column, Column]:
    x, y, z = direction(az, el)
    return clamp(dist * x, -1.0, 1.0) + 0.0, clamp(dist * y, -1.0, 1.0) + 0.0, clamp(dist * z, 0.0, 1.0) + 0.0


def quaternion_to_ypr(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Yaw, pitch and roll in degrees (turns about z, y, x in this order); a near-zero quaternion gives nulls."""
    norm = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = (F.when(norm > 1e-9, c / norm) for c in (w, x, y, z))
    yaw = F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
    pitch = F.asin(clamp(2 * (w * y - z * x), -1.0, 1.0))
    roll = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    return F.degrees(yaw), F.degrees(pitch), F.degrees(roll)


def quantize(beat: Column, grid: float = 0.25, strength: float = 1.0, swing: float = 0.0) -> Column:
    if grid <= 0 or strength <= 0:
        return beat
    slot = half_away(beat / grid)
    target = slot * grid + F.when(F.pmod(slot, F.lit(2)) != 0, swing * grid if swing > 0 else 0.0).otherwise(0.0)
    return F.greatest(beat + min(strength, 1.0) * (target - beat), F.lit(0.0))


def groove_slot(beat: Column, grid: float, steps: int) -> Column:
    return F.pmod(half_away(beat / grid), F.lit(steps)).cast("int")


def scale_velocity(v: Column, scale: float, offset: float = 0.0, center: float = 64.0) -> Column:
    return clamp(half_away(center + (v - center) * scale + offset), 1, 127).cast("int")


def transpose(pitch: Column, semitones: int) -> Column:
    moved = pitch + semitones
    return F.when(moved.between(0, 127), moved).otherwise(pitch)


def stretch(beat: Column, factor: float, anchor: float = 0.0) -> Column:
    return anchor + (beat - anchor) * factor


def encode_send(offset: Column, width: Column) -> Column:
    """The packed source channel of a send; null for widths that have no code."""
    code = F.when(width == 1, 1).when(width == 2, 0).when((width >= 4) & (width % 2 == 0), (width / 2).cast("int"))
    return offset.bitwiseAND(1023).bitwiseOR(F.shiftleft(code, 10))


def decode_send_width(packed: Column) -> Column:
    code = F.shiftright(packed, 10)
    return F.when(packed < 0, 0).when(code == 0, 2).when(code == 1, 1).otherwise(code * 2)


def cc_type(status: Column) -> Column:
    high = status.bitwiseAND(240)
    names = {160: "poly_aftertouch", 176: "cc", 192: "program_change", 208: "channel_pressure", 224: "pitch_bend"}
    return reduce(lambda e, k: e.when(high == k, names[k]), names, F.when(F.lit(False), "")).otherwise("other")


def cc_value(status: Column, msg2: Column, msg3: Column) -> Column:
    high = status.bitwiseAND(240)
    return F.when(high == 224, msg2.bitwiseOR(F.shiftleft(msg3, 7))).when(high.isin(160, 176), msg3).otherwise(msg2)


def default_shaped(name: Column) -> Column:
    """A name that a template gave: empty, or track, object or audio and a number."""
    return (name == "") | name.rlike(r"(?i)^(track|object|audio) ?[0-9]+$")


def slug(name: Column, fallback: str) -> Column:
    out = F.regexp_replace(name, r"[^A-Za-z0-9_\-]", "_")
    return F.when(out.rlike(r"^_*$"), fallback).otherwise(out)


def adm_time(seconds: Column) -> Column:
    ticks = F.floor(F.greatest(seconds, F.lit(0.0)) * 100000 + 0.5)
    part = lambda n, size: F.format_string(f"%0{size}d", n.cast("bigint"))
    whole = F.floor(ticks / 100000)
    return F.concat(part(F.floor(whole / 3600), 2), F.lit(":"), part(F.floor(whole / 60) % 60, 2), F.lit(":"), part(whole % 60, 2), F.lit("."), part(ticks % 100000, 5))


def hex_digits(number: Column, size: int = 4) -> Column:
    """The low `size` hexadecimal digits, in lower case."""
    return F.format_string(f"%0{size}x", number.cast("bigint").bitwiseAND(F.lit(16**size - 1).cast("bigint")))


def fmt_num(value: Column) -> Column:
    """Six decimals without the zeros behind them."""
    return F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"\.?0+$", "")


def xml_escape(text: Column) -> Column:
    for mark, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = F.replace(text, F.lit(mark), F.lit(f"&{name};"))
    return text


def yaml_quote(text: Column) -> Column:
    """In double quotes, with quotes, backslashes and line ends escaped."""
    for mark, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(mark), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def json_quote(text: Column) -> Column:
    """A text as a JSON string: quotes, backslashes and control characters escaped, others as they are. Null is the empty string."""
    out = F.coalesce(text, F.lit(""))
    for mark, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(mark), F.lit(escaped))
    rest = F.when(out.rlike(r"[\x00-\x1F]"), F.array_join(F.transform(F.split(out, ""), lambda c: F.when((c != "") & (F.ascii(c) < 32), F.concat(F.lit("\\u"), F.format_string("%04x", F.ascii(c)))).otherwise(c)), "")).otherwise(out)
    return F.concat(F.lit('"'), rest, F.lit('"'))


def yaml_path(text: Column) -> Column:
    """A path as it is where letters, digits and _ - . / are all it has, else in quotes."""
    return F.when(text.rlike(r"^[A-Za-z0-9_\-./]+$"), text).otherwise(yaml_quote(text))


def clamp_el(el: Column) -> Column:
    """Degrees within -90 and 90."""
    return clamp(el, -90.0, 90.0)


def nudge(beat: Column, by: float) -> Column:
    """A start moved, not before zero."""
    return F.greatest(beat + by, F.lit(0.0))


def cc_encode(kind: Column, channel: Column, number: Column, value: Column) -> tuple[Column, Column, Column]:
    """(status, msg2, msg3) of a control event of a kind (see cc_type); nulls for other kinds and for what is out of range.

    Program changes and channel pressures have one byte of value, pitch bends 14 bits, the others a number and a value."""
    codes = {"poly_aftertouch": 160, "cc": 176, "program_change": 192, "channel_pressure": 208, "pitch_bend": 224}
    code = F.coalesce(*[F.when(kind == k, v) for k, v in codes.items()])
    bend, single = code == 224, code.isin(192, 208)
    two = ~bend & ~single
    fits = channel.between(0, 15) & value.between(0, F.when(bend, 16383).otherwise(127)) & (~two | number.between(0, 127))
    ok = code.isNotNull() & F.coalesce(fits, F.lit(False))
    low = F.when(bend, value.bitwiseAND(127)).when(single, value).otherwise(number)
    high = F.when(bend, F.shiftright(value, 7)).when(single, 0).otherwise(value)
    return F.when(ok, code.bitwiseOR(channel)), F.when(ok, low), F.when(ok, high)
