"""Fixed values of the domain: tempo bands, weights, roles, codecs and profiles."""

from __future__ import annotations

#: Band -> (lowest, highest) BPM, and the spacing of grid points from the lowest.
BANDS = {"slow": (70, 84), "downtempo": (85, 95), "midtempo": (96, 119), "house": (120, 128), "uptempo": (129, 152), "fast": (153, 182)}
GRID_SPACING = 5
MOST_STRETCH = 0.10


def grid_of(low: int, high: int, spacing: int = GRID_SPACING) -> list[int]:
    return list(range(low, high + 1, spacing))


#: Parts of a match score, its cutoff and the length of a ranked list.
W_BPM, W_KEY, W_ENERGY, BPM_PENALTY = 0.45, 0.35, 0.20, 0.35
CUTOFF, TOP = 0.40, 20
#: Parts of a transition score, window and hop in bars, markers kept, and the role of a frame without one.
T_ENERGY, T_PHASE, T_SPECTRAL, T_ROLE = 0.35, 0.30, 0.20, 0.15
FIT_ROLE, FIT_POSITION = 0.6, 0.4
WINDOW_BARS, HOP_BARS, BEATS_PER_BAR, MARKERS, REGIONS, OTHER_ROLE = 8, 1, 4, 5, 3, 0.4
#: How well a section suits leaving and entering.
EXIT_ROLES = {"outro": 1.0, "breakdown": 0.85, "verse": 0.5, "drop": 0.25, "intro": 0.2}
ENTRY_ROLES = {"intro": 1.0, "breakdown": 0.85, "verse": 0.5, "drop": 0.3, "outro": 0.2}
#: Licence variants and their restrictions (no derivatives, share alike, non-commercial).
VARIANTS = {"BY": (0, 0, 0), "BY-SA": (0, 1, 0), "BY-ND": (1, 0, 0), "BY-NC": (0, 0, 1), "BY-NC-SA": (0, 1, 1), "BY-NC-ND": (1, 0, 1)}
LICENCE = r"^CC (BY(?:-NC)?(?:-SA|-ND)?) (1\.0|2\.0|2\.5|3\.0|4\.0)(?: ([A-Z]{2}))?$"
LICENCE_URL = r"(?i)creativecommons\.org/licenses/(by(?:-nc)?(?:-sa|-nd)?)/(1\.0|2\.0|2\.5|3\.0|4\.0)/(?:([a-z]{2})/)?"
#: Codec -> (extension, media type).
CODECS = {"aac": ("m4a", "audio/mp4"), "opus": ("opus", "audio/ogg"), "wav": ("wav", "audio/wav")}
#: How far a track has come, in order.
STATUSES = ["pending", "fetched", "analyzed", "ready"]
DECK_SIZE, BATCH = 10, 50
#: Key profiles (major, minor), tonic names, their Camelot codes and equal names.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
TONICS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
CAMELOT_MAJOR = ["8B", "3B", "10B", "5B", "12B", "7B", "2B", "9B", "4B", "11B", "6B", "1B"]
CAMELOT_MINOR = ["5A", "12A", "7A", "2A", "9A", "4A", "11A", "6A", "1A", "8A", "3A", "10A"]
FLATS = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#"}
