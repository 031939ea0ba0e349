"""Times, labels, padding, pixel budgets and tiles of frames as column expressions; no frame is decoded here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def loader_steps(duration: Column, fps: Column, most: int) -> Column:
    """Frames at equal steps, one for each second and at most most; null for less than a second."""
    n = F.least(F.lit(most), F.floor(duration).cast("int"))
    step = F.floor(F.try_divide(F.floor(duration * fps), n)).cast("long")
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i * step))


def timestamps(duration: Column, most: int) -> Column:
    """Seconds of the frames: most of them spread over a longer duration, else each whole second."""
    whole = F.floor(duration).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: duration / F.lit(float(most)) * i)
    each = F.when(whole >= 1, F.transform(F.sequence(F.lit(0), F.greatest(whole, F.lit(1)) - 1), lambda i: i.cast("double"))).otherwise(F.array().cast("array<double>"))
    return F.when(duration > most, spread).otherwise(each)


def time_labels(places: Column, rate: Column) -> Column:
    """Places divided by rate as seconds with two digits, joined by commas."""
    return F.array_join(F.transform(places, lambda p: F.format_string("%.2fs", p.cast("double") / rate)), ",")


def sample_fps(n: Column, total: Column, fps: Column) -> Column:
    return n / F.greatest(total.cast("double"), F.lit(1e-6)) * fps


def exactly(places: Column, k: int) -> Column:
    """Sorted places; an error unless there are k."""
    return F.when(F.size(places) == k, F.sort_array(places)).otherwise(F.raise_error(F.concat(F.lit(f"{k} places are wanted, there are "), F.size(places).cast("string"))))


def thinned(items: Column, places: Column, distinct: bool = False, last: bool = False) -> Column:
    """items at places, each once if distinct; with last, the final item follows if it is not among them."""
    if distinct:
        places = F.array_distinct(places)
    if last:
        end = (F.size(items) - 1).cast("long")
        places = F.when(F.array_contains(places, end), places).otherwise(F.concat(places, F.array(end)))
    return F.transform(places, lambda p: F.get(items, p.cast("int")))


def padded(items: Column, factor: int = 2) -> Column:
    """items with the last repeated up to a multiple of factor."""
    short = F.pmod(-F.size(items), F.lit(factor))
    return F.when(F.size(items) > 0, F.concat(items, F.array_repeat(F.element_at(items, -1), short))).otherwise(items)


def pixel_budget(frames: Column, least: Column, most: Column, total: Column, wanted: Column, factor: int = 2) -> Column:
    """Pixels that a frame may have: its part of the total, within bounds, and no more than wanted (null: no wish)."""
    bound = F.greatest(F.least(most.cast("double"), total / frames * factor), F.floor(least * F.lit(1.05)).cast("double"))
    return F.least(F.coalesce(wanted.cast("double"), bound), bound)


def tile_grids(least: int = 1, most: int = 6) -> list[tuple[int, int]]:
    """Grids (columns, rows) with least to most tiles by their number of tiles; ties by columns."""
    grids = [(i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most]
    return sorted(grids, key=lambda g: (g[0] * g[1], g))


def closest_grid(width: Column, height: Column, size: int = 448, least: int = 1, most: int = 6) -> Column:
    """The grid whose shape is closest to the image's, as (i, j). Of equally close ones a later, larger grid is
    taken only if the image has more than half of its pixels."""
    grids = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in tile_grids(least, most)])
    shape, area = width.cast("double") / height, width.cast("double") * height
    off = lambda g: F.abs(shape - g["i"].cast("double") / g["j"])
    better = lambda a, g: (off(g) < off(a)) | ((off(g) == off(a)) & (area > 0.5 * size * size * g["i"] * g["j"]))
    return F.aggregate(grids, grids[0], lambda a, g: F.when(better(a, g), g).otherwise(a))


def crop_boxes(grid: Column, size: int = 448) -> Column:
    """Boxes (left, top, right, bottom) of a grid's tiles, row by row."""

    def box(n: Column) -> Column:
        x, y = n % grid["i"] * size, F.floor(n / grid["i"]).cast("int") * size
        return F.struct(x.alias("left"), y.alias("top"), (x + size).alias("right"), (y + size).alias("bottom"))

    return F.transform(F.sequence(F.lit(0), grid["i"] * grid["j"] - 1), box)
