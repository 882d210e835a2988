"""A PySpark engine for ordered sports-tracking data, and for preparing training text."""

from trackloom.config import CONFIG, Config
from trackloom.functions.geometry import homographies
from trackloom.operators.render import bone_segments, court_lines, frame_overlays, overlays, player_dots, view_court
from trackloom.plans.analysis import analyze, callbacks, detect, documents, failures

__all__ = ["CONFIG", "Config", "analyze", "bone_segments", "callbacks", "court_lines", "detect", "documents", "failures", "frame_overlays", "homographies", "overlays", "player_dots", "view_court"]
