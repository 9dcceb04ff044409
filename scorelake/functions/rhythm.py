"""Durations, meters, keys and pitches as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beats of the named durations, in quarter notes.
BEATS = {
    "whole": 4.0,
    "half": 2.0,
    "quarter": 1.0,
    "eighth": 0.5,
    "sixteenth": 0.25,
    "thirty_second": 0.125,
}
# Semitones of the scale degrees and MIDI numbers of the tonics.
DEGREES = {"1": 0, "2": 2, "3": 4, "4": 5, "5": 7, "6": 9, "7": 11}
TONICS = {"C": 60, "D": 62, "E": 64, "F": 65, "G": 67, "A": 69, "B": 71}
# Lengths a digital source maps to, first wins on a tie.
NAMED_LENGTHS = [
    (4.0, "whole", 0),
    (3.0, "half", 1),
    (2.0, "half", 0),
    (1.5, "quarter", 1),
    (1.0, "quarter", 0),
    (0.75, "eighth", 1),
    (0.5, "eighth", 0),
    (0.375, "sixteenth", 1),
    (0.25, "sixteenth", 0),
]
BEAT_GRID = 32  # every note length above is a multiple of 1/32 quarter


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in values.items() for v in kv])


def lookup(values: dict, key: Column, default=None) -> Column:
    found = literal_map(values)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def note_beats(duration: Column, dots: Column) -> Column:
    base = lookup(BEATS, duration, 1.0)
    factor = F.when(dots >= 2, 1.75).when(dots == 1, 1.5).otherwise(1.0)
    return base * factor


def meter_capacity(meter: Column) -> Column:
    """Quarter-note beats of a bar; 4 when the meter cannot be read."""
    num = F.regexp_extract(meter, r"^\s*([+-]?\d+)\s*/\s*([+-]?\d+)\s*$", 1)
    den = F.regexp_extract(meter, r"^\s*([+-]?\d+)\s*/\s*([+-]?\d+)\s*$", 2)
    num, den = num.try_cast("double"), den.try_cast("double")
    return F.coalesce(num * F.try_divide(F.lit(4.0), den), F.lit(4.0))


def nearest_length(beats: Column) -> Column:
    """Struct(duration, dots) of the named length nearest to ``beats``."""
    table = F.array(
        *[
            F.struct(
                F.abs(F.lit(b) - beats).alias("d"),
                F.lit(i).alias("i"),
                F.lit(name).alias("duration"),
                F.lit(dots).alias("dots"),
            )
            for i, (b, name, dots) in enumerate(NAMED_LENGTHS)
        ]
    )
    return F.array_min(table)


def length_from_marks(dashes: Column, dots: Column) -> tuple[Column, Column]:
    """(duration, dots) of a text token followed by dash and dot marks."""
    name = F.when(dashes >= 3, "whole").when(dashes >= 1, "half").otherwise("quarter")
    capped = F.least(dots, F.lit(2))
    return name, F.when(dashes == 2, F.greatest(capped, F.lit(1))).otherwise(capped)


def pitch_token(pitch: Column, accidental: Column) -> Column:
    mark = F.when(accidental == "sharp", "#").when(accidental == "flat", "b").otherwise("")
    return F.concat(pitch, mark)


def tonic_midi(key: Column) -> Column:
    raw = F.trim(F.when(F.coalesce(key, F.lit("")) == "", "C").otherwise(key))
    solfa = F.regexp_extract(raw, r"1\s*=\s*([A-Ga-g])([b#]?)", 0)
    letter = F.when(solfa != "", F.regexp_extract(raw, r"1\s*=\s*([A-Ga-g])([b#]?)", 1)).otherwise(
        F.regexp_extract(raw, r"^([A-Ga-g])([b#]?)", 1)
    )
    mark = F.when(solfa != "", F.regexp_extract(raw, r"1\s*=\s*([A-Ga-g])([b#]?)", 2)).otherwise(
        F.regexp_extract(raw, r"^([A-Ga-g])([b#]?)", 2)
    )
    shift = F.when(mark == "b", -1).when(mark == "#", 1).otherwise(0)
    return F.when(letter == "", F.lit(60)).otherwise(lookup(TONICS, F.upper(letter), 60) + shift)


def midi_number(
    pitch: Column, octave: Column, key: Column, accidental: Column | None = None
) -> Column:
    shift = F.lit(0)
    if accidental is not None:
        shift = F.when(accidental == "sharp", 1).when(accidental == "flat", -1).otherwise(0)
    number = tonic_midi(key) + lookup(DEGREES, pitch) + F.coalesce(octave, F.lit(0)) * 12 + shift
    return F.greatest(F.lit(0), F.least(F.lit(127), number))


def midi_hz(midi: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (midi - 69) / F.lit(12.0))


def beat_ms(tempo: Column) -> Column:
    return F.lit(60000.0) / F.when(tempo > 0, tempo).otherwise(80.0)
