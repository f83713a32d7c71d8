"""Closed vocabularies.  Fixed values: they must be these for results to be right."""

from __future__ import annotations

KINDS = ("wall", "door", "window", "furniture", "unknown")
DEFAULT_CATEGORIES = (
    "bed", "desk", "chair", "sofa", "coffee_table", "dining_table", "side_table", "nightstand", "wardrobe", "tv_cabinet",
    "bookcase", "sideboard", "cupboard", "dressing_table", "stool", "carpet", "curtain", "plants", "tv", "computer",
    "floor-standing_lamp", "chandelier", "painting", "mirror",
)

SOFT = ("carpet", "curtain", "painting", "mirror", "chandelier", "floor-standing_lamp", "plants", "computer")
SOFT_ON_WALLS = ("painting", "mirror", "curtain")
LOW = ("carpet", "stool", "side_table", "coffee_table", "nightstand")
SEATS = ("sofa", "couch", "chair", "armchair", "stool")
PRIMARY_SEATS = ("sofa", "couch", "armchair")
TABLES = ("coffee_table", "dining_table", "side_table")
BEDS = ("bed",)
DESKS = ("desk", "dressing_table")
NIGHTSTANDS = ("nightstand",)
LAMPS = ("floor-standing_lamp", "table_lamp", "lamp", "chandelier")
COMPUTERS = ("computer",)
FOCAL = ("tv", "fireplace")

PRINCIPLES = (
    "command_position", "solid_backing", "bed_aligned_with_door", "mirror_faces_bed", "clear_center",
    "sharp_corner_points_at_seat", "pairing_balance", "door_alignment", "light_window_proximity",
)
STATUSES = ("violated", "weak", "good")
STATUS_SCORES = (0.0, 0.5, 1.0)

LABELS = (
    "desk", "dressing_table", "coffee_table", "dining_table", "side_table", "nightstand", "sofa", "couch", "chair", "armchair",
    "stool", "wardrobe", "tv_cabinet", "bookcase", "sideboard", "cupboard", "tv", "computer", "fireplace", "floor-standing_lamp",
    "table_lamp", "lamp", "chandelier", "mirror", "painting", "carpet", "curtain", "rug", "plants", "bed", "wall", "door",
    "window", "room", "seating_group", "bed_group", "desk_group",
)
NODE_TYPES = ("object", "wall", "door", "window", "room", "zone")
EDGE_TYPES = (
    "near", "faces", "overlaps", "parallel_to", "in_front_of", "behind", "left_of", "right_of", "table_for", "touching_wall",
    "against_wall", "parallel_to_wall", "has_backing", "door_in_wall", "window_in_wall", "inside_room", "outside_room",
    "focal_point_of", "participates_in", "blocks_path", "serves", "traffic_path", "entry_path",
)
#: continuous features of an edge, in order
EDGE_FEATURES = ("distance_m", "angle_diff_deg", "angle_error_deg", "clearance_m", "yaw_diff_deg", "coverage", "overlap_m2", "length_m")
HEAD_TYPES = ("object", "room", "door")
#: principles that apply to a node type; none to other types
APPLICABLE = {
    "object": ("command_position", "solid_backing", "bed_aligned_with_door", "mirror_faces_bed", "sharp_corner_points_at_seat", "pairing_balance", "light_window_proximity"),
    "room": ("clear_center",),
    "door": ("door_alignment",),
}
IMPACTS = {
    "command_position": "high", "solid_backing": "high", "bed_aligned_with_door": "high", "mirror_faces_bed": "medium", "clear_center": "medium",
    "sharp_corner_points_at_seat": "medium", "pairing_balance": "low", "door_alignment": "medium", "light_window_proximity": "low",
}
SCORE_LABELS = ((0.85, "Excellent"), (0.65, "Good"), (0.45, "Fair"), (0.25, "Poor"), (0.0, "Very Poor"))

COMMON_ENGLISH = ("the", "and", "to", "of", "a", "in", "is", "it", "you", "that", "for", "on", "with", "this", "be", "as", "are", "was", "at", "have", "your")
TEXT_PRINCIPLES = {
    "command_position": ("command position", "see the door", "view of the door", "visible from entry"),
    "solid_backing": ("against the wall", "backed by wall", "solid wall behind", "wall backing"),
    "bed_aligned_with_door": ("bed facing door", "bed aligned with door", "bed in line with door"),
    "mirror_faces_bed": ("mirror facing bed", "mirror reflects bed"),
    "clear_center": ("clear the center", "open center", "center clutter"),
    "sharp_corner_points_at_seat": ("sharp corner", "poison arrow", "corner points at"),
    "pairing_balance": ("nightstands on both sides", "balanced pair", "symmetry around bed"),
    "door_alignment": ("door alignment", "doors in line", "straight line from door"),
    "light_window_proximity": ("near window", "natural light", "window proximity"),
    "bed_under_window": ("bed under window", "headboard under window"),
    "bed_under_beam": ("bed under beam",),
    "clutter_under_bed": ("clutter under bed", "storage under bed"),
    "shoes_at_door": ("shoes at door", "entry clutter"),
    "water_feature_placement": ("water feature", "aquarium placement", "fountain placement"),
    "plants_in_corner": ("plants in corner", "corner plant"),
    "color_scheme": ("color palette", "colors in room", "paint color"),
    "broken_items": ("broken items", "fix broken", "remove broken"),
}
ACTIONS = ("move", "rotate", "remove", "declutter", "add", "place", "swap", "reorient", "clear", "push", "pull", "center", "align", "turn")
TARGETS = (
    "bed", "desk", "chair", "sofa", "couch", "coffee_table", "dining_table", "side_table", "nightstand", "wardrobe", "tv_cabinet", "bookcase",
    "sideboard", "cupboard", "mirror", "door", "window", "tv", "computer", "floor-standing_lamp", "chandelier", "painting", "plants", "carpet",
    "curtain", "rug", "entry",
)
TOPICS = ("feng shui", "layout", "room", "bedroom", "living room", "office", "couch", "sofa", "bed", "desk", "mirror", "door", "window", "tv", "entry", "clutter", "furniture")
AVOID = ("don't", "dont", "never", "avoid", "not ")
