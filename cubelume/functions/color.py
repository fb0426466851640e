"""Colour arithmetic as Column expressions; channels are 0 to 255, hue, saturation and value 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sqrt(3) * 255, the largest distance of two colours, as the scores take it.
FARTHEST = 441.67


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def pack(r: Column, g: Column, b: Column, alpha: int | None = 255) -> Column:
    """ARGB as a long; without alpha, RGB."""
    rgb = F.shiftleft(r.cast("long"), 16).bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(b.cast("long"))
    return rgb if alpha is None else rgb.bitwiseOR(F.lit(alpha << 24).cast("long"))


def unpack(argb: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(argb, s).bitwiseAND(F.lit(255).cast("long")).cast("int") for s in (16, 8, 0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def to_u8(x: Column) -> Column:
    """Truncated to 0 to 255."""
    return F.floor(clamp(x, 0.0, 255.0)).cast("int")


def luma_milli(r: Column, g: Column, b: Column) -> Column:
    """1000 times the BT.601 luminance, exact: what palettes are ranked by."""
    return (r * 299 + g * 587 + b * 114).cast("long")


def luma709(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def brightness(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 765.0


def saturation(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top > 0, (top - low) / top.cast("double")).otherwise(0.0)


def squared_distance(a: tuple, b: tuple) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0).cast("long"))


def distance(a: tuple, b: tuple) -> Column:
    return F.sqrt(squared_distance(a, b).cast("double"))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    top, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    d = top - low
    h = F.when(d == 0, 0.0).when(top == r, ((g - b) / d) % 6).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return F.when(h < 0, h + 1).otherwise(h), F.when(top > 0, d / top).otherwise(0.0), top / 255.0


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    h, _, _ = hsv(r, g, b)
    top, low = F.greatest(r, g, b) / 255.0, F.least(r, g, b) / 255.0
    light, d = (top + low) / 2, top - low
    return h, F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * light - 1))), light


def _from_hue(h: Column, chroma: Column, base: Column) -> tuple[Column, Column, Column]:
    k = h * 6
    x = chroma * (1 - F.abs(k % 2 - 1))
    zero = F.lit(0.0)
    sector = F.floor(k) % 6

    def pick(*six: Column) -> Column:
        out = F.when(sector == 0, six[0])
        for i, c in enumerate(six[1:], 1):
            out = out.when(sector == i, c)
        return to_u8(F.round((out + base) * 255, 9))

    return pick(chroma, x, zero, zero, x, chroma), pick(x, chroma, chroma, x, zero, zero), pick(zero, zero, x, chroma, chroma, x)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    return _from_hue(h, v * s, v - v * s)


def hsl_to_rgb(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    chroma = (1 - F.abs(2 * light - 1)) * s
    return _from_hue(h, chroma, light - chroma / 2)


def _linear(c: Column) -> Column:
    v = c / 255.0
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


def xyz(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """D65, of sRGB; white has Y = 100."""
    r, g, b = (_linear(c) * 100 for c in (r, g, b))
    return r * 0.4124564 + g * 0.3575761 + b * 0.1804375, r * 0.2126729 + g * 0.7151522 + b * 0.0721750, r * 0.0193339 + g * 0.1191920 + b * 0.9503041


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)

    x, y, z = xyz(r, g, b)
    x, y, z = f(x / 95.047), f(y / 100.0), f(z / 108.883)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def with_delta_e2000(df: DataFrame, one: tuple[str, str, str], two: tuple[str, str, str], out: str) -> DataFrame:
    """df with the CIEDE2000 of two Lab colours (column names), by the published formula (Sharma et al.).

    Each step is a projection of its own: what later steps name many times is computed once, and the generated code stays small."""
    (l1, a1, b1), (l2, a2, b2) = (tuple(F.col(c) for c in side) for side in (one, two))
    c = lambda n: F.col(f"__{n}")
    keep = df.columns

    def step(d: DataFrame, **new: Column) -> DataFrame:
        return d.withColumns({f"__{n}": v for n, v in new.items()})

    def angle(b: Column, p: Column) -> Column:
        return F.when((b == 0) & (p == 0), 0.0).otherwise((F.degrees(F.atan2(b, p)) + 360) % 360)

    cos = lambda x: F.cos(F.radians(x))
    d = step(df, c7=F.pow((F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2, F.lit(7)))
    d = step(d, g=0.5 * (1 - F.sqrt(c("c7") / (c("c7") + 25.0**7))))
    d = step(d, p1=a1 * (1 + c("g")), p2=a2 * (1 + c("g")))
    d = step(d, d1=F.sqrt(c("p1") * c("p1") + b1 * b1), d2=F.sqrt(c("p2") * c("p2") + b2 * b2), h1=angle(b1, c("p1")), h2=angle(b2, c("p2")))
    d = step(d, grey=c("d1") * c("d2") == 0, apart=c("h2") - c("h1"), sum=c("h1") + c("h2"), cm=(c("d1") + c("d2")) / 2)
    dh = F.when(c("grey"), 0.0).when(F.abs(c("apart")) <= 180, c("apart")).when(c("apart") > 180, c("apart") - 360).otherwise(c("apart") + 360)
    hm = F.when(c("grey"), c("sum")).when(F.abs(c("apart")) <= 180, c("sum") / 2).when(c("sum") < 360, (c("sum") + 360) / 2).otherwise((c("sum") - 360) / 2)
    d = step(d, dh=dh, hm=hm, cm7=F.pow(c("cm"), F.lit(7)), off=F.pow((l1 + l2) / 2 - 50, F.lit(2)))
    h = c("hm")
    d = step(d, t=1 - 0.17 * cos(h - 30) + 0.24 * cos(2 * h) + 0.32 * cos(3 * h + 6) - 0.20 * cos(4 * h - 63), turn=30 * F.exp(-F.pow((h - 275) / 25, F.lit(2))))
    d = step(
        d,
        x=(l2 - l1) / (1 + 0.015 * c("off") / F.sqrt(20 + c("off"))),
        y=(c("d2") - c("d1")) / (1 + 0.045 * c("cm")),
        z=2 * F.sqrt(c("d1") * c("d2")) * F.sin(F.radians(c("dh") / 2)) / (1 + 0.015 * c("cm") * c("t")),
        rt=-F.sin(F.radians(2 * c("turn"))) * 2 * F.sqrt(c("cm7") / (c("cm7") + 25.0**7)),
    )
    square = c("x") * c("x") + c("y") * c("y") + c("z") * c("z") + c("rt") * c("y") * c("z")
    return d.select(*[F.col(f"`{n}`") for n in keep], F.sqrt(F.greatest(F.lit(0.0), square)).alias(out))


def relative_luminance(r: Column, g: Column, b: Column) -> Column:
    """WCAG, 0 to 1."""

    def f(c: Column) -> Column:
        v = c / 255.0
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * f(r) + 0.7152 * f(g) + 0.0722 * f(b)


def contrast_ratio(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def text_on(luminance: Column) -> Column:
    return F.when(contrast_ratio(luminance, F.lit(1.0)) > 4.5, "white").otherwise("black")


def bucket332(r: Column, g: Column, b: Column) -> Column:
    return (F.shiftleft(F.shiftright(r, 5), 5) + F.shiftleft(F.shiftright(g, 5), 2) + F.shiftright(b, 6)).cast("int")


def bucket_centre(bucket: Column) -> tuple[Column, Column, Column]:
    return tuple((x * w + w / 2).cast("int") for x, w in ((F.shiftright(bucket, 5), 32), (F.shiftright(bucket, 2).bitwiseAND(7), 32), (bucket.bitwiseAND(3), 64)))


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)])


def from_hex(text: Column) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(text, 2 + 2 * i, 2), 16, 10).cast("int") for i in range(3))


def hue_name(h: Column) -> Column:
    # fixed values: upper ends of the hue ranges
    out = F.when((h < 0.05) | (h >= 0.95), "Ruby")
    for top, name in ((0.15, "Amber"), (0.25, "Gold"), (0.40, "Emerald"), (0.50, "Cyan"), (0.65, "Sapphire"), (0.75, "Violet"), (0.85, "Magenta"), (0.95, "Rose")):
        out = out.when(h < top, name)
    return out.otherwise("Neutral")


def mood(h: Column, s: Column, v: Column) -> Column:
    """Of mean hue, saturation and value; the first that holds."""
    warm, cool = (h < 0.15) | (h > 0.85), (h > 0.45) & (h < 0.75)
    vibrant, muted, bright, dark = s > 0.6, s < 0.3, v > 0.7, v < 0.3
    out = F.when(vibrant & warm, "vibrant sunset").when(vibrant & cool, "electric neon").when(muted & bright, "pastel dream").when(muted & dark, "moody noir")
    return out.when(warm & bright, "warm summer").when(cool & dark, "deep ocean").when(s < 0.2, "vintage film").otherwise("balanced")


def ramp(name: str, i: Column) -> tuple[Column, Column, Column]:
    """Colour i of 0 to 255 of a named palette."""
    t, x = i / 255.0, i.cast("double")
    u8 = lambda c: to_u8(F.round(c, 9))
    zero, full = F.lit(0), F.lit(255)
    if name == "linear":
        return i, i, i
    if name == "gamma":
        grey = F.floor(F.pow(t, F.lit(1 / 2.2)) * 255 + 0.5).cast("int")
        return grey, grey, grey
    if name == "high_contrast":
        grey = F.floor(F.round(clamp(((t - 0.5) * 1.5 + 0.5) * 255, 0.0, 255.0), 9) + 0.5).cast("int")
        return grey, grey, grey
    if name == "sepia":
        return u8(x * 1.2), u8(x * 0.9), u8(x * 0.6)
    if name == "inverted":
        return bucket_centre(255 - i)
    if name == "thermal":
        a, b, c = t < 0.25, t < 0.5, t < 0.75
        q = F.when(a, t * 4).when(b, (t - 0.25) * 4).when(c, (t - 0.5) * 4).otherwise((t - 0.75) * 4) * 255
        return F.when(b, zero).when(c, u8(q)).otherwise(full), F.when(a, zero).when(b, u8(q)).when(c, full).otherwise(u8(255 - q * 0.5)), F.when(a, u8(q)).when(b, full).when(c, u8(255 - q)).otherwise(u8(q))
    if name == "heatmap":
        a, b = t < 0.33, t < 0.66
        return F.when(a, u8(t * 3 * 255)).otherwise(full), F.when(a, zero).when(b, u8((t - 0.33) * 3 * 255)).otherwise(full), F.when(b, zero).otherwise(u8((t - 0.66) * 3 * 255))
    if name == "neon":
        return hsv_to_rgb(i / 256.0, F.lit(1.0), t)
    raise ValueError(name)


RAMPS = ("linear", "gamma", "high_contrast", "sepia", "inverted", "thermal", "heatmap", "neon")
