"""A graph attention network over rooms, in numpy: forward pass, predictions, losses.

Rooms are rows with their nodes and edges; a batch holds many, and the weights travel with the task.  Attention is the
GATv2 form: a score is a vector's product with the activated sum of what source, target and edge map to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SceneConfig
from ..functions import tape as t
from ..functions import vocab
from ..functions.geometry import keyed
from . import room_edges as re
from .encoding import index_of
from .polygons import _parts
from .relations import is_in, soft

FORWARD = (("object", "spatial", "object"), ("object", "to_wall", "wall"), ("door", "aperture_wall", "wall"), ("window", "aperture_wall", "wall"), ("object", "to_room", "room"), ("door", "to_room", "room"), ("window", "to_room", "room"), ("object", "to_zone", "zone"), ("door", "door_to_zone", "zone"), ("door", "entry_path", "object"))
RELATIONS = FORWARD + tuple((to, f"rev_{r}", of) for of, r, to in FORWARD)
EDGE_SIZE, NODE_SIZE = len(vocab.EDGE_FEATURES) + len(vocab.EDGE_TYPES) + 1, 8


@dataclass(frozen=True)
class ModelConfig:
    hidden: int = 32
    heads: int = 4
    layers: int = 2
    label_size: int = 16
    lambda_score: float = 0.5
    lambda_graph: float = 0.25


def init_weights(config: ModelConfig = ModelConfig(), seed: int = 0) -> dict[str, np.ndarray]:
    r, h, out = np.random.default_rng(seed), config.hidden, {}

    def linear(name: str, rows: int, columns: int, bias: bool = True) -> None:
        bound = math.sqrt(6 / (rows + columns))
        out[f"{name}.w"] = r.uniform(-bound, bound, (rows, columns))
        if bias:
            out[f"{name}.b"] = np.zeros(columns)

    def norm(name: str) -> None:
        out[f"{name}.scale"], out[f"{name}.shift"] = np.ones(h), np.zeros(h)

    out["labels"] = r.normal(0, 1, (len(vocab.LABELS) + 1, config.label_size))
    for kind in vocab.NODE_TYPES:
        linear(f"in.{kind}", NODE_SIZE + config.label_size, h)
        norm(f"in.{kind}")
    for k in range(config.layers):
        for rel in RELATIONS:
            name = f"{k}.{'.'.join(rel)}"
            linear(f"{name}.source", h, h)
            linear(f"{name}.target", h, h)
            linear(f"{name}.edge", EDGE_SIZE, h, bias=False)
            out[f"{name}.attention"] = r.uniform(-0.5, 0.5, (config.heads, h // config.heads))
            out[f"{name}.bias"] = np.zeros(h)
        for kind in vocab.NODE_TYPES:
            norm(f"{k}.norm.{kind}")
    for kind in vocab.HEAD_TYPES:
        linear(f"head.{kind}", h, len(vocab.PRINCIPLES) * len(vocab.STATUSES))
    linear("score.0", 2 * h, h)
    linear("score.1", h, 1)
    return out


def _attended(source: t.Var, target: t.Var, src: np.ndarray, dst: np.ndarray, features: np.ndarray, w: dict[str, t.Var], name: str, heads: int) -> t.Var:
    left = source @ w[f"{name}.source.w"] + w[f"{name}.source.b"]
    right = target @ w[f"{name}.target.w"] + w[f"{name}.target.b"]
    taken = left.rows(src)
    mixed = t.leaky(taken + right.rows(dst) + t.Var(features) @ w[f"{name}.edge.w"]).reshaped(len(src), heads, -1)
    share = t.shares_by((mixed * w[f"{name}.attention"]).total(axis=2), dst, len(target.value))
    parts = share.reshaped(len(src), heads, 1) * taken.reshaped(len(src), heads, -1)
    return parts.into(dst, len(target.value)).reshaped(len(target.value), -1) + w[f"{name}.bias"]


def attend(source: np.ndarray, target: np.ndarray, src: np.ndarray, dst: np.ndarray, features: np.ndarray, w: dict, name: str, heads: int) -> np.ndarray:
    """What every target node takes from its incoming edges of one relation."""
    return _attended(t.Var(source), t.Var(target), src, dst, features, {k: t.Var(v) for k, v in w.items()}, name, heads).value


def node_states(nodes: dict[str, tuple[np.ndarray, np.ndarray]], edges: dict[tuple[str, str, str], tuple[np.ndarray, np.ndarray, np.ndarray]], w: dict[str, t.Var], config: ModelConfig = ModelConfig()) -> dict[str, t.Var]:
    """What all layers make of the nodes, by type.  Graphs that no edge connects don't change each other."""
    x = {k: t.normed(t.gelu(t.joined([t.Var(f), w["labels"].rows(labels)], axis=1) @ w[f"in.{k}.w"] + w[f"in.{k}.b"]), w[f"in.{k}.scale"], w[f"in.{k}.shift"]) for k, (f, labels) in nodes.items()}
    for layer in range(config.layers):
        got: dict[str, t.Var] = {}
        for rel in RELATIONS:
            if rel in edges and rel[0] in x and rel[2] in x:
                part = _attended(x[rel[0]], x[rel[2]], *edges[rel], w, f"{layer}.{'.'.join(rel)}", config.heads)
                got[rel[2]] = got[rel[2]] + part if rel[2] in got else part
        x = {k: t.normed(v + t.gelu(got[k]) if k in got else v, w[f"{layer}.norm.{k}.scale"], w[f"{layer}.norm.{k}.shift"]) for k, v in x.items()}
    return x


def _logits(x: dict[str, t.Var], w: dict[str, t.Var]) -> dict[str, t.Var]:
    return {k: (x[k] @ w[f"head.{k}.w"] + w[f"head.{k}.b"]).reshaped(len(x[k].value), len(vocab.PRINCIPLES), len(vocab.STATUSES)) for k in vocab.HEAD_TYPES if k in x}


def _scored(pooled: t.Var, w: dict[str, t.Var]) -> t.Var:
    return t.gelu(pooled @ w["score.0.w"] + w["score.0.b"]) @ w["score.1.w"] + w["score.1.b"]


def forward(nodes: dict[str, tuple[np.ndarray, np.ndarray]], edges: dict[tuple[str, str, str], tuple[np.ndarray, np.ndarray, np.ndarray]], w: dict[str, t.Var], config: ModelConfig = ModelConfig()) -> tuple[dict[str, t.Var], t.Var | None]:
    """nodes: features and labels by type; edges: sources, targets, features by relation.  Logits by head type, and the graph's logit."""
    x = node_states(nodes, edges, w, config)
    present = [x[k] for k in vocab.NODE_TYPES if k in x]
    if not present:
        return _logits(x, w), None
    return _logits(x, w), _scored(t.mean_and_max(t.joined(present, axis=0)), w)


def _tensors(room: dict) -> tuple[dict, dict, dict[str, list], dict[str, int]]:
    """What forward() reads of a room's row, its nodes by type, and the place of each node among those of its type."""
    by_type: dict[str, list] = {}
    place = {}
    for node in room["nodes"]:
        group = by_type.setdefault(node["node_type"], [])
        place[node["id"]] = len(group)
        group.append(node)
    vectors = {k: (np.array([v["features"] for v in g], float), np.array([v["label_ix"] for v in g])) for k, g in by_type.items()}
    groups: dict[tuple, list] = {}
    for edge in room["edges"] or ():
        groups.setdefault((edge["src_type"], edge["relation"], edge["dst_type"]), []).append((place[edge["src"]], place[edge["dst"]], edge["features"]))
    return vectors, {rel: tuple(np.array(c) for c in zip(*g, strict=True)) for rel, g in groups.items()}, by_type, place


def room_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """room, nodes and edges (lists): one row for each room."""
    n = nodes.groupBy("room").agg(F.sort_array(F.collect_list(F.struct("id", "node_type", "label_ix", "features"))).alias("nodes"))
    e = edges.groupBy("room").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "src_type", "relation", "dst_type", "features"))).alias("edges"))
    return n.join(keyed(e), "room", "left")


#: nodes and edges of the rooms that predictions() works out at once
ROWS_AT_ONCE = 10000


def _codes(column: pa.Array, names: tuple[str, ...]) -> np.ndarray:
    """The place of each name, -1 for any other."""
    return pc.fill_null(pc.index_in(column, pa.array(names)), -1).to_numpy(zero_copy_only=False)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Of rows with lists of structs: the row of every struct, and the fields."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(sizes)), sizes), dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))


def _vectors(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _predicted(batch: pa.RecordBatch, w: dict[str, t.Var], config: ModelConfig, reverse: bool) -> Iterator[list[pa.Array]]:
    """Columns of the predictions for some rooms, all as one graph; the rooms' scores are pooled apart."""
    of, nodes = _lists(batch.column("nodes"))
    kind, labels, features = _codes(nodes["node_type"], vocab.NODE_TYPES), nodes["label_ix"].to_numpy(zero_copy_only=False), _vectors(nodes["features"], NODE_SIZE)
    at = [np.flatnonzero(kind == k) for k in range(len(vocab.NODE_TYPES))]
    place = np.zeros(len(kind), np.int64)
    for own in at:
        place[own] = np.arange(len(own))
    links = {}
    of_edge, edges = _lists(batch.column("edges"))
    if len(of_edge):
        names = pa.concat_arrays([nodes["id"], edges["src"], edges["dst"]]).dictionary_encode()
        code, kinds = names.indices.to_numpy(), len(vocab.NODE_TYPES) + 1
        node_key, src_code, dst_code = np.split(code.astype(np.int64), [len(of), len(of) + len(of_edge)])
        key = lambda room, name, k: (room * len(names.dictionary) + name) * kinds + k + 1
        keys = key(of, node_key, kind)
        order = np.argsort(keys, kind="stable")
        types = [_codes(edges[c], vocab.NODE_TYPES) for c in ("src_type", "dst_type")]
        src, dst = (place[order[np.searchsorted(keys[order], key(of_edge, name, k), "right") - 1]] for name, k in zip((src_code, dst_code), types, strict=True))
        relation, numbers = _codes(edges["relation"], tuple(r for _, r, _ in RELATIONS)), _vectors(edges["features"], EDGE_SIZE)
        known = [r for _, r, _ in RELATIONS]
        for rel in RELATIONS:
            mine = np.flatnonzero((relation == known.index(rel[1])) & (types[0] == vocab.NODE_TYPES.index(rel[0])) & (types[1] == vocab.NODE_TYPES.index(rel[2])))
            if len(mine):
                links[rel] = src[mine], dst[mine], numbers[mine]
                if reverse:
                    links[rel[2], f"rev_{rel[1]}", rel[0]] = dst[mine], src[mine], numbers[mine]
    states = node_states({vocab.NODE_TYPES[k]: (features[own], labels[own]) for k, own in enumerate(at) if len(own)}, links, w, config)
    total, most, count = np.zeros((batch.num_rows, config.hidden)), np.full((batch.num_rows, config.hidden), -np.inf), np.bincount(of, minlength=batch.num_rows)
    for k, own in enumerate(at):
        if len(own):
            value = states[vocab.NODE_TYPES[k]].value
            np.add.at(total, of[own], value)
            np.maximum.at(most, of[own], value)
    graph = 1 / (1 + np.exp(-_scored(t.Var(np.concatenate([total / count[:, None], most], axis=1)), w).value[:, 0]))
    for name, logits in _logits(states, w).items():
        own = at[vocab.NODE_TYPES.index(name)]
        for p, principle in enumerate(vocab.PRINCIPLES):
            if principle in vocab.APPLICABLE[name]:
                rows = logits.value[:, p]
                share = np.exp(rows - rows.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                status = pa.DictionaryArray.from_arrays(pa.array(share.argmax(axis=1).astype(np.int32)), pa.array(vocab.STATUSES)).cast(pa.string())
                score = [round(v, 4) for v in (share @ np.array(vocab.STATUS_SCORES)).tolist()]
                offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * rows.shape[1])
                yield [batch.column("room").take(pa.array(of[own])), nodes["id"].take(pa.array(own)), pa.array([principle] * len(own)), status, pa.array(score), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel())), pa.array(graph[of[own]])]


def predictions(nodes: DataFrame, edges: DataFrame, weights: dict[str, np.ndarray], config: ModelConfig = ModelConfig(), reverse: bool = False) -> DataFrame:
    """room, target, principle, status, score, logits and the room's graph_score.

    nodes and edges as encoding.node_vectors() and edge_vectors(reverse=True) give them; with reverse=True here, edges have
    one way only, and the other is added where they are read.  Many rooms are worked out as one graph.
    """
    rows = room_graphs(nodes, edges).select("room", "nodes", "edges")
    schema = "room long, target string, principle string, status string, score double, logits array<double>, graph_score double"
    names = [c.split()[0] for c in schema.split(", ")]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: t.Var(v) for k, v in weights.items()}
        for batch in batches:
            sizes = sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("nodes", "edges"))
            ends, start = np.cumsum(sizes), 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ROWS_AT_ONCE + (ends[start - 1] if start else 0), "right")))
                for columns in _predicted(batch.slice(start, stop - start), held, config, reverse):
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                start = stop

    return rows.mapInArrow(predicted, schema)


#: pieces, fixtures, walls and pairs of pieces of the rooms that scene_predictions() works out at once
PAIRS_AT_ONCE = 4000

_PER_UNIT = 1024
_TERMS = 4


def _normal_shares() -> list[np.ndarray]:
    """Coefficients of the normal distribution's expansion about every multiple of 1 / _PER_UNIT from -9 to 9."""
    z = np.arange(-9 * _PER_UNIT, 9 * _PER_UNIT + 1) / _PER_UNIT
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    share = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z.tolist()])
    return [share, density, -z * density / 2, (z * z - 1) * density / 6, (3 * z - z**3) * density / 24]


def gelus(x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """tape.gelu() of an array, by _normal_shares(): beyond 9 the share is 0 or 1 to the last digit that counts."""
    near = np.clip(x, -9.0, 9.0)
    at = np.rint(near * _PER_UNIT)
    rest = near - at / _PER_UNIT
    at = at.astype(np.int32) + 9 * _PER_UNIT
    share = tables[_TERMS].take(at)
    for table in tables[_TERMS - 1 :: -1]:
        share *= rest
        share += table.take(at)
    return x * share


def _normed(x: np.ndarray, w: dict[str, np.ndarray], name: str) -> np.ndarray:
    x = x - x.mean(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x) / x.shape[1] + 1e-5)[:, None]
    return x * w[f"{name}.scale"] + w[f"{name}.shift"]


def _taken(source: np.ndarray, target: np.ndarray, src: np.ndarray, dst: np.ndarray, edges: tuple[np.ndarray, np.ndarray], w: dict[str, np.ndarray], name: str, heads: int) -> tuple[np.ndarray, np.ndarray]:
    """attend() for edges ordered by their targets, without the bias: the targets that have edges, and what they take."""
    numbers, kinds = edges
    start = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
    sizes = np.diff(np.r_[start, len(dst)])
    taken = (source @ w[f"{name}.source.w"] + w[f"{name}.source.b"])[src]
    mixed = (target @ w[f"{name}.target.w"] + w[f"{name}.target.b"])[dst]
    mixed += taken
    mixed += numbers @ w[f"{name}.edge.w"][: numbers.shape[1]]
    mixed += w[f"{name}.edge.w"][numbers.shape[1] + kinds]
    np.maximum(mixed, 0.2 * mixed, out=mixed)
    width = mixed.shape[1] // heads
    logits = mixed @ (np.kron(np.eye(heads), np.ones((width, 1))) * w[f"{name}.attention"].reshape(-1, 1))
    share = np.exp(logits - np.repeat(np.maximum.reduceat(logits, start), sizes, axis=0))
    share /= np.repeat(np.add.reduceat(share, start) + 1e-16, sizes, axis=0)
    taken *= np.repeat(share, width, axis=1)
    return dst[start], np.add.reduceat(taken, start)


def head_states(nodes: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], links: dict[tuple[str, str, str], tuple], w: dict[str, np.ndarray], tables: list[np.ndarray], config: ModelConfig = ModelConfig()) -> dict[str, np.ndarray]:
    """node_states() of the types that have heads, for many rooms: only what these states are made of is worked out.

    nodes: features, labels and rooms by type; links: sources, targets, numbers and types of edges by relation, with both
    ways.  A relation's bias goes to the nodes of rooms that have the relation, as if each room were by itself.
    """
    needed = [set(vocab.HEAD_TYPES)]
    for _ in range(config.layers):
        needed.insert(0, needed[0] | {a for a, _, b in links if b in needed[0]})
    rooms = {k: v[2] for k, v in nodes.items()}
    x = {k: _normed(gelus(np.concatenate([f, w["labels"][labels]], axis=1) @ w[f"in.{k}.w"] + w[f"in.{k}.b"], tables), w, f"in.{k}") for k, (f, labels, _) in nodes.items() if k in needed[0]}
    ordered = {}
    for rel, (src, dst, *edges) in links.items():
        order = np.argsort(dst, kind="stable")
        ordered[rel] = src[order], dst[order], tuple(e[order] for e in edges)
    for layer in range(config.layers):
        got: dict[str, np.ndarray] = {}
        for rel in RELATIONS:
            if rel in ordered and rel[2] in needed[layer + 1]:
                name = f"{layer}.{'.'.join(rel)}"
                out = got.setdefault(rel[2], np.zeros_like(x[rel[2]]))
                at, part = _taken(x[rel[0]], x[rel[2]], *ordered[rel], w, name, config.heads)
                out[at] += part
                if w[f"{name}.bias"].any():
                    out[np.isin(rooms[rel[2]], rooms[rel[2]][at])] += w[f"{name}.bias"]
        x = {k: _normed(v + gelus(got[k], tables) if k in got else v, w, f"{layer}.norm.{k}") for k, v in x.items() if k in needed[layer + 1]}
    return x


def _rounded(values: np.ndarray) -> np.ndarray:
    """Four digits as round() gives them."""
    scaled = values * 1e4
    out = np.rint(scaled) / 1e4
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[k] = round(float(values[k]), 4)
    return out


_BOX = ("x", "y", "z", "yaw", "width", "depth", "height")


def _scene_rows(furniture: DataFrame, walls: DataFrame, fixtures: DataFrame) -> DataFrame:
    """room, pieces, walls and fixtures (lists): one row for each room."""
    label = index_of(F.lower("label"), vocab.LABELS).alias("label_ix")
    may = F.coalesce(~soft(F.col("label")) | is_in(F.col("label"), vocab.SOFT_ON_WALLS), F.lit(False)).alias("on_wall")
    numbers = [F.col(c).cast("double").alias(c) for c in _BOX if c != "z"]
    parts = {"pieces": furniture.select("room", F.struct("ord", "id", label, may, *numbers, F.col("z").cast("double").alias("z")).alias("pieces"))}
    parts["walls"] = walls.select("room", F.struct("id", "ax", "ay", "bx", "by", "height", "thickness").alias("walls"))
    label = index_of(F.lower("kind"), vocab.LABELS).alias("label_ix")
    parts["fixtures"] = fixtures.select("room", F.struct("id", "kind", label, "wall_id", *numbers).alias("fixtures"))
    rows = None
    for part in parts.values():
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.groupBy("room").agg(*(F.collect_list(c).alias(c) for c in parts))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _scene_graphs(batch: pa.RecordBatch, scene: SceneConfig) -> tuple[dict, dict, dict]:
    """Of the rooms of _scene_rows(): what head_states() reads, and the row and the id of every node by type."""
    known = batch.column("room").is_valid().to_numpy(zero_copy_only=False)
    (p_of, pieces), (f_of, fixed), (w_of, walls) = (_lists(batch.column(c)) for c in ("pieces", "fixtures", "walls"))
    n_p, n_f = len(p_of), len(f_of)
    box, ends = (np.stack([_numbers(part[c]) for c in names]) for part, names in ((pieces, ("x", "y", "width", "depth", "yaw")), (walls, ("ax", "ay", "bx", "by"))))
    dx, dy = ends[2] - ends[0], ends[3] - ends[1]
    height = _numbers(walls["height"])
    as_box = {"x": (ends[0] + ends[2]) / 2, "y": (ends[1] + ends[3]) / 2, "z": height / 2, "yaw": np.arctan2(dy, dx), "width": np.sqrt(dx * dx + dy * dy), "depth": np.fmax(_numbers(walls["thickness"]), 0.02), "height": height}
    own = {c: np.nan_to_num(np.concatenate([_numbers(pieces[c]), _numbers(fixed[c]) if c != "z" else np.zeros(n_f), as_box[c]]), nan=0.0) for c in _BOX}
    features = np.stack([own["x"], own["y"], own["z"], np.sin(own["yaw"]), np.cos(own["yaw"]), own["width"], own["depth"], own["height"]], axis=1)
    labels = np.concatenate([pieces["label_ix"].to_numpy(zero_copy_only=False), fixed["label_ix"].to_numpy(zero_copy_only=False), np.full(len(w_of), vocab.LABELS.index("wall"))])
    of = np.concatenate([p_of, f_of, w_of])
    types = vocab.NODE_TYPES
    opening = pc.fill_null(pc.index_in(fixed["kind"], pa.array(["door", "window"])), 2).to_numpy(zero_copy_only=False)
    kind = np.concatenate([np.full(n_p, types.index("object")), np.array([types.index(k) for k in ("door", "window", "object")])[opening], np.full(len(w_of), types.index("wall"))])
    # edges, by place among pieces, fixtures and walls
    in_room, of_room = (np.bincount(o, minlength=batch.num_rows) for o in (p_of, w_of))
    first_piece, first_wall = (np.cumsum(n) - n for n in (in_room, of_room))
    ord_ = _numbers(pieces["ord"])
    linked = known[p_of] & ~np.isnan(ord_)
    parts = re.object_edges(box, ord_, np.where(linked, in_room[p_of], 0), first_piece[p_of], scene)
    may = known[p_of] & pieces["on_wall"].to_numpy(zero_copy_only=False).astype(bool)
    beside = re.wall_edges(box, np.where(may, of_room[p_of], 0), first_wall[p_of], ends, scene)
    parts += [(s, t + n_p + n_f, *rest) for s, t, *rest in beside]
    # a fixture and the wall it names: all walls of its room are looked at
    names = pa.concat_arrays([fixed["wall_id"], walls["id"]]).dictionary_encode().indices
    code = pc.fill_null(names, -1).to_numpy(zero_copy_only=False)
    for s, t in re._of_pairs(np.where(known[f_of] & (code[:n_f] >= 0), of_room[f_of], 0), first_wall[f_of]):
        held = code[s] == code[n_f + t]
        s, t = s[held], t[held]
        entry = np.array([re.TYPE["door_in_wall"], re.TYPE["window_in_wall"], len(vocab.EDGE_TYPES)])[opening[s]]
        parts.append((s + n_p, t + n_p + n_f, entry, {}))
    edges = re.Edges.of(parts)
    at = {k: np.flatnonzero(kind == i) for i, k in enumerate(types)}
    place = np.zeros(len(kind), np.int64)
    for rows in at.values():
        place[rows] = np.arange(len(rows))
    links = {}
    ends_of = kind[edges.src] * len(types) + kind[edges.dst]
    for a, name, b in FORWARD:
        mine = np.flatnonzero(ends_of == types.index(a) * len(types) + types.index(b))
        if len(mine):
            src, dst, more = place[edges.src[mine]], place[edges.dst[mine]], (edges.numbers[mine], edges.type[mine])
            links[a, name, b] = src, dst, *more
            links[b, f"rev_{name}", a] = dst, src, *more
    ids = pa.concat_arrays([pieces["id"], fixed["id"], walls["id"]])
    return {k: (features[rows], labels[rows], of[rows]) for k, rows in at.items() if len(rows)}, links, {k: (of[rows], ids.take(pa.array(rows))) for k, rows in at.items()}


def scene_predictions(furniture: DataFrame, walls: DataFrame, fixtures: DataFrame, weights: dict[str, np.ndarray], config: ModelConfig = ModelConfig(), scene: SceneConfig = SceneConfig()) -> DataFrame:
    """room, target, principle, status and score, as predictions() gives them for the graph of pieces, walls and fixtures.

    A room is one row from its pieces on: its edges are laid out where the model reads them, so that neither edges nor
    their features are written, joined or sorted.  weights: the edges' ones have the continuous features first.
    """
    schema = "room long, target string, principle string, status string, score double"
    names = [c.split()[0] for c in schema.split(", ")]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, worth = _normal_shares(), np.array(vocab.STATUS_SCORES)
        for batch in batches:
            counts = [pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pieces", "fixtures", "walls")]
            for some in _parts(counts[0] ** 2 + sum(counts), PAIRS_AT_ONCE):
                rooms = batch.slice(some.start, some.stop - some.start)
                nodes, links, named = _scene_graphs(rooms, scene)
                for kind, x in head_states(nodes, links, weights, tables, config).items():
                    mine = [vocab.PRINCIPLES.index(p) for p in vocab.PRINCIPLES if p in vocab.APPLICABLE[kind]]
                    logits = (x @ weights[f"head.{kind}.w"] + weights[f"head.{kind}.b"]).reshape(len(x), len(vocab.PRINCIPLES), -1)[:, mine]
                    share = np.exp(logits - logits.max(axis=2, keepdims=True))
                    share /= share.sum(axis=2, keepdims=True)
                    of, ids = named[kind]
                    each = pa.array(np.repeat(np.arange(len(x)), len(mine)))
                    principle, status = pa.array(np.tile(mine, len(x))), pa.array(share.argmax(axis=2).ravel())
                    yield pa.RecordBatch.from_arrays([rooms.column("room").take(pa.array(np.repeat(of, len(mine)))), ids.take(each), pa.array(vocab.PRINCIPLES).take(principle), pa.array(vocab.STATUSES).take(status), pa.array(_rounded((share @ worth).ravel()))], names=names)

    return _scene_rows(furniture, walls, fixtures).mapInArrow(predicted, schema)


def smooth_l1(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d < 1, d * d / 2).otherwise(d - 0.5)


def losses(cells: DataFrame, graphs: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """room, status_loss, score_loss, graph_loss and total.

    cells: room, node_type, logits, status_ix, score, weight of supervised cells.  graphs: room, graph_score (as predicted,
    0 to 1), target (null if there is none).  Parts are means over a node type's cells, summed over types.
    """
    from .scoring import expected_score, softmax

    entropy = -F.log(F.get(softmax(F.col("logits")), F.col("status_ix"))) * F.col("weight")
    by_type = cells.groupBy("room", "node_type").agg(F.avg(entropy).alias("ce"), F.avg(smooth_l1(expected_score(F.col("logits")), F.coalesce("score", F.lit(0.0)))).alias("l1"))
    parts = by_type.groupBy("room").agg(F.sum("ce").alias("status_loss"), F.sum("l1").alias("score_loss"))
    rows = graphs.join(keyed(parts), "room", "left").withColumn("graph_loss", smooth_l1(F.col("graph_score"), F.col("target")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.select("room", "status_loss", "score_loss", "graph_loss", (zero("status_loss") + config.lambda_score * zero("score_loss") + config.lambda_graph * zero("graph_loss")).alias("total"))
