"""Hexagon ids from coordinates and back, over whole columns.

The grid lies on the faces of an icosahedron. Each face is a plane on which the sphere is projected from its centre, with the
complex number 1 towards one of its vertices; a cell of resolution 0 has the distance 1 to its neighbours, the vertices
are at 2, 2w and 2w², where w is the third root of one. A finer grid is seven times as dense and turned: a cell with the
number c = a + bw of one resolution has the children c * BETA + d, d being 0 or one of six units. So digits come from
dividing by BETA with remainder, and everything below is arithmetic on such numbers.

A digit is held as the angle of its unit in steps of 60 degrees, or CENTRE. All digits of an id refer to the frame of the home
face of its base cell; from another face they are turned. Twelve base cells lie around vertices, where only five faces
meet: there the digits of the angle MISSING do not occur first, and what lies past one side of the gap continues behind
the other one.

Nothing but the places of ten faces, the homes of base cells on edges and the order of base cells (by latitude, north first) is
given; neighbours of faces, turns and base cells follow from the geometry.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Latitude and longitude in radians of the centres of faces 0 to 9.
FACES = [
    (0.803582649718989942, 1.248397419617396099),
    (1.307747883455638156, 2.536945009877921159),
    (1.054751253523952054, -1.347517358900396623),
    (0.600191595538186799, -0.450603909469755746),
    (0.491715428198773866, 0.401988202911306943),
    (0.172745327415618701, 1.678146885280433686),
    (0.605929321571350690, 2.953923329812411617),
    (0.427370518328979641, -1.888876200336285401),
    (-0.079066118549212831, -0.733429513380867741),
    (-0.230961644455383637, 0.506495587332349035),
]
#: Faces 10 to 19 lie opposite these.
OPPOSITE = [8, 9, 5, 6, 7, 3, 4, 0, 1, 2]
#: Fixed value: angles of the edges whose base cells have their home on a face, for faces 0-4, 5-9, 10-14 and 15-19.
HOME_EDGES = [(1, 3), (5,), (1,), (5, 3)]
#: Digits of the angles 0 to 5, and of the centre.
DIGITS = [4, 6, 2, 3, 1, 5, 0]
CENTRE, MISSING = 6, 4
#: The angles around a vertex, counter-clockwise without the missing one.
AROUND = [3, 5, 0, 1, 2]
#: Distance of neighbouring base cells on a face, in units of the distance from the sphere's centre.
UNIT = (3 - 5**0.5) / 2
W = complex(-0.5, 3**0.5 / 2)
TURN = np.exp(1j * np.pi / 3 * np.arange(6))
#: a, b of the six units and of 0.
STEPS = np.array([(1, 0), (1, 1), (0, 1), (-1, 0), (-1, -1), (0, -1), (0, 0)])
ANGLE_OF = np.full((3, 3), -1)
ANGLE_OF[STEPS[:, 0], STEPS[:, 1]] = np.arange(7)
#: No descendant's centre is farther from a base cell's centre, in degrees; at each resolution less by the root of seven.
REACH = 14.0


def xyz(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], -1)


class Grid:
    """Frames and neighbours of faces; base cells by face and place."""

    def __init__(self):
        c = xyz(*np.array(FACES).T)
        self.centre = c = np.concatenate([c, -c[OPPOSITE]])
        near = np.arccos(np.clip(c @ c.T, -1, 1))
        side = np.sort(near, 1)[0, 1]  # between faces with an edge in common
        # vertices, from three faces in a row around each
        corners = []
        for f in range(20):
            for g in range(20):
                if f != g and abs(near[f, g] - side) < 1e-9:
                    for k in range(20):
                        if k not in (f, g) and abs(near[g, k] - side) < 1e-9 and abs(near[f, k] - side) > 1e-9:
                            v = self._apex(c, (f, g, k))
                            if not any(np.allclose(v, x) for x in corners):
                                corners.append(v)
        self.corners = np.array(corners)
        of = [np.flatnonzero(self.corners @ c[f] > np.max(self.corners @ c[f]) - 1e-9) for f in range(20)]
        top = set(of[0]).intersection(*of[1:5]).pop()
        bottom = set(of[15]).intersection(*of[16:20]).pop()
        upper = {v for f in range(5) for v in of[f]} - {top}
        tip = lambda f: top if f < 5 else bottom if f >= 15 else next(v for v in of[f] if (v in upper) == (f >= 10))
        self.towards = np.array([self._tangent(c[f], self.corners[tip(f)]) for f in range(20)])
        self.across = np.cross(c, self.towards)
        # the vertex at 2, 2w and 2w² of each face
        self.vertex = np.array([[int(np.argmax(self.corners @ self.point(np.array([f]), np.array([2 * W**k]))[0])) for k in range(3)] for f in range(20)])
        self._edges()
        self._bases()

    @staticmethod
    def _apex(c: np.ndarray, faces: tuple[int, int, int]) -> np.ndarray:
        """The vertex in which three faces in a row around it meet: as far from each of them."""
        a, b, k = (c[f] for f in faces)
        v = np.cross(a - b, b - k)
        v /= np.linalg.norm(v)
        return v if v @ b > 0 else -v

    @staticmethod
    def _tangent(at: np.ndarray, to: np.ndarray) -> np.ndarray:
        t = to - (to @ at) * at
        return t / np.linalg.norm(t)

    def point(self, face: np.ndarray, z: np.ndarray) -> np.ndarray:
        """On the sphere."""
        p = self.centre[face] + UNIT * (z.real[:, None] * self.towards[face] + z.imag[:, None] * self.across[face])
        return p / np.linalg.norm(p, axis=1, keepdims=True)

    def plane(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest face, and the place on it."""
        face = np.argmax(p @ self.centre.T, axis=1)
        q = p / np.sum(p * self.centre[face], 1, keepdims=True)
        return face, (np.sum(q * self.towards[face], 1) + 1j * np.sum(q * self.across[face], 1)) / UNIT

    def _edges(self) -> None:
        """Across the edges whose middles have the angles 1, 3, 5: the other face, and place * turn + shift there."""
        self.other, self.turn, self.shift = np.zeros((20, 3), int), np.zeros((20, 3), complex), np.zeros((20, 3), complex)
        self.steps = np.zeros((20, 3), int)
        for f in range(20):
            for e in range(3):
                i, j = e, (e + 1) % 3  # the vertices at its ends
                pair = {self.vertex[f, i], self.vertex[f, j]}
                g = next(g for g in range(20) if g != f and pair <= set(self.vertex[g]))
                at = {v: 2 * W**k for k, v in enumerate(self.vertex[g])}
                a, b = 2 * W**i, 2 * W**j
                turn = (at[self.vertex[f, i]] - at[self.vertex[f, j]]) / (a - b)
                self.other[f, e], self.steps[f, e] = g, round(np.angle(turn) / (np.pi / 3)) % 6
                self.turn[f, e] = TURN[self.steps[f, e]]
                self.shift[f, e] = at[self.vertex[f, i]] - self.turn[f, e] * a

    def _bases(self) -> None:
        """Base cells: their numbers, homes and places there, and for each face and place the number and the turn to its home."""
        homes = [(f, *STEPS[CENTRE]) for f in range(20)] + [(f, *STEPS[k]) for f in range(20) for k in (0, 2, 4)]
        homes += [(f, *STEPS[k]) for f in range(20) for k in HOME_EDGES[f // 5]]
        homes += [(f, 2, 0) for f in (0, *range(5, 15), 19)]
        lat = self.point(np.array([h[0] for h in homes]), np.array([h[1] + h[2] * W for h in homes]))[:, 2]
        homes = [homes[i] for i in np.argsort(-lat)]
        self.home, self.place = np.array([h[0] for h in homes]), np.array([h[1] + h[2] * W for h in homes])
        self.pentagon = np.array([h[1:] == (2, 0) for h in homes])
        self.base, self.to_home = np.full((20, 5, 5), -1), np.zeros((20, 5, 5), int)
        # around a vertex: the angle of the face's middle as its own frame and as the home's frame has it
        self.own_angle, self.home_angle = np.zeros((20, 5, 5), int), np.zeros((20, 5, 5), int)
        self.wedge = np.zeros((122, 6, 2), int)  # of a vertex and an angle: the face, and which of its vertices it is
        for n, (f, a, b) in enumerate(homes):
            self.base[f, a, b] = n
            if self.pentagon[n]:
                v, g = self.vertex[f, 0], f
                for angle in (3, 5, 0, 1, 2):  # counter-clockwise
                    k = int(np.flatnonzero(self.vertex[g] == v)[0])
                    at = tuple((2 * STEPS[2 * k]).tolist())
                    self.base[g][at], self.own_angle[g][at], self.home_angle[g][at] = n, (3 + 2 * k) % 6, angle
                    self.wedge[n, angle] = g, k
                    # counter-clockwise around its vertex k, a face ends at the edge from there to vertex k + 2
                    g = self.other[g, (k + 2) % 3]
            elif (a, b) in [(1, 1), (-1, 0), (0, -1)]:
                e = [(1, 1), (-1, 0), (0, -1)].index((a, b))
                g = self.other[f, e]
                z = self.turn[f, e] * (a + b * W) + self.shift[f, e]
                p, q = _nearest(np.array([z]))
                self.base[g, p[0], q[0]], self.to_home[g, p[0], q[0]] = n, -self.steps[f, e] % 6
        # cells of other faces that begin at an edge: their descendants reach over it
        for f in range(20):
            for a, b in [(2, 1), (1, 2), (-1, 1), (-2, -1), (-1, -2), (1, -1)]:
                g, z, steps = self.fold(np.array([f]), np.array([a + b * W]))
                p, q = _nearest(z)
                self.base[f, a, b], self.to_home[f, a, b] = self.base[g[0], p[0], q[0]], steps[0]

    def fold(self, face: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places that may lie past edges as places on the faces that hold them, and the steps that the frame turned."""
        face, z, steps = face.copy(), z.copy(), np.zeros(len(z), int)
        for _ in range(3):
            past = np.stack([(z * np.conj(TURN[a])).real for a in (1, 3, 5)], 1)
            e = past.argmax(1)
            out = np.flatnonzero(past[np.arange(len(z)), e] > 1 + 1e-9)
            if not len(out):
                break
            f, g = face[out], e[out]
            z[out] = z[out] * self.turn[f, g] + self.shift[f, g]
            face[out], steps[out] = self.other[f, g], (steps[out] + self.steps[f, g]) % 6
        return face, z, steps


@cache
def grid() -> Grid:
    return Grid()


def _nearest(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a, b of the nearest a + bw."""
    b = z.imag / W.imag
    a = z.real + b / 2
    low = [np.floor(a).astype(np.int64), np.floor(b).astype(np.int64)]
    every = [(low[0] + i, low[1] + j) for i in (0, 1) for j in (0, 1)]
    best = np.argmin([np.abs(z - (p + q * W)) for p, q in every], axis=0)
    rows = np.arange(len(z))
    return np.stack([p for p, _ in every])[best, rows], np.stack([q for _, q in every])[best, rows]


def scale(res: int) -> complex:
    """BETA of all resolutions up to ``res``, multiplied."""
    return 7.0 ** (res // 2) * ((2 - W) if res % 2 else 1)


def _divide(a: np.ndarray, b: np.ndarray, odd: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotient by BETA of an odd or even resolution, and the angle of the remainder."""
    near = lambda x: (2 * x + 7) // 14
    p, q = (near(3 * a - b), near(a + 2 * b)) if odd else (near(2 * a + b), near(3 * b - a))
    x, y = (2 * p + q, 3 * q - p) if odd else (3 * p - q, p + 2 * q)
    return p, q, ANGLE_OF[a - x, b - y]


def _pack(base: np.ndarray, angles: list[np.ndarray], res: int) -> np.ndarray:
    h = np.full(len(base), (1 << 59) | (res << 52) | ((1 << 3 * (15 - res)) - 1), np.int64) | (base.astype(np.int64) << 45)
    for r, m in enumerate(angles, 1):
        h |= np.array(DIGITS)[m].astype(np.int64) << 3 * (15 - r)
    return h


def _turned(angles: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return np.where(angles == CENTRE, CENTRE, (angles + steps) % 6)


def _leading(angles: list[np.ndarray], n: int) -> np.ndarray:
    lead = np.full(n, CENTRE)
    for m in angles:
        lead = np.where(lead == CENTRE, m, lead)
    return lead


def from_plane(face: np.ndarray, a: np.ndarray, b: np.ndarray, res: int) -> np.ndarray:
    """Ids of the cells a + bw of resolution ``res`` on faces that hold them."""
    g, angles = grid(), []
    for r in range(res, 0, -1):
        a, b, m = _divide(a, b, r % 2 == 1)
        angles.insert(0, m)
    base, steps = g.base[face, a, b], g.to_home[face, a, b]
    lead = _leading(angles, len(face))
    own, home = g.own_angle[face, a, b], g.home_angle[face, a, b]
    # past the gap's side: to its other side
    off = np.where(lead == MISSING, np.where(own == 3, 1, -1), 0)
    first = np.where(lead == CENTRE, 0, (lead + off) % 6)
    order = np.zeros(6, int)
    order[AROUND] = np.arange(5)
    new = np.array(AROUND)[(order[first] + order[home] - order[own]) % 5]
    steps = np.where(g.pentagon[base], np.where(lead == CENTRE, 0, off + new - first), steps)
    return _pack(base, [_turned(m, steps) for m in angles], res)


def cells(lng: np.ndarray, lat: np.ndarray, res: int) -> np.ndarray:
    """Ids of the cells of resolution ``res`` that hold the points, in degrees."""
    face, z = grid().plane(xyz(np.radians(lat), np.radians(lng)))
    return from_plane(face, *_nearest(z * scale(res)), res)


def parts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Base cells, resolutions and the angles of 15 digits, CENTRE below the resolution."""
    res, base = (h >> 52) & 15, (h >> 45) & 127
    angle = np.full(8, CENTRE)
    angle[DIGITS] = np.arange(7)
    return base, res, [np.where(r <= res, angle[(h >> 3 * (15 - r)) & 7], CENTRE) for r in range(1, 16)]


def _vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base cells, resolutions, leading angles, and places from the base cells' centres in their homes' frames."""
    base, res, angles = parts(h)
    z, unit = np.zeros(len(h), complex), np.concatenate([TURN, [0]])
    for r, m in enumerate(angles, 1):
        z += unit[m] / scale(r)
    return base, res, _leading(angles, len(h)), z


def _on_faces(base: np.ndarray, lead: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Faces and places of places in the homes' frames from the base cells' centres, and the steps that the frame turned.
    ``lead`` tells the side of the gap that a place at a vertex belongs to."""
    g = grid()
    face, at, steps = g.fold(g.home[base], g.place[base] + z)
    pent = np.flatnonzero(g.pentagon[base] & (np.abs(z) > 1e-12))
    if len(pent):
        zp, n = z[pent], base[pent]
        angle = np.angle(zp) / (np.pi / 3) % 6
        gap = (angle > 3.5 + 1e-9) & (angle < 4.5 - 1e-9)
        off = np.where(gap, np.where(np.isin(lead[pent], (2, 3)), 1, -1), 0)
        wedge = np.floor(angle + off + 0.5).astype(int) % 6
        wedge = np.where(wedge == MISSING, np.where(angle < 4, 3, 5), wedge)  # on a side of the gap
        f, k = g.wedge[n, wedge].T
        turn = (3 + 2 * k - wedge + off) % 6
        face[pent], steps[pent] = f, turn
        at[pent] = 2 * W**k + zp * TURN[turn]
    return face, at, steps


def _degrees(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(np.arctan2(p[:, 1], p[:, 0])), np.degrees(np.arcsin(np.clip(p[:, 2], -1, 1)))


def centres(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes of the cells' centres, in degrees."""
    base, _, lead, z = _vectors(h)
    face, at, _ = _on_faces(base, lead, z)
    return _degrees(grid().point(face, at))


def is_pentagon(h: np.ndarray) -> np.ndarray:
    base, _, angles = parts(h)
    return grid().pentagon[base] & (_leading(angles, len(h)) == CENTRE)


def _beside(h: np.ndarray, far: complex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Faces and places ``far`` from the centres, in units and the frame of each cell's own grid; the third says where there
    is such a place, which around a pentagon is so in five directions only."""
    base, res, lead, z = _vectors(h)
    beta = np.array([scale(r) for r in range(16)])[res]
    pent = grid().pentagon[base]
    # at a vertex, a place past the gap's side has gone over to the other side, with the frame that is valid there
    angle = np.angle(z) / (np.pi / 3) % 6
    gap = pent & (np.abs(z) > 1e-12) & (angle > 3.5 + 1e-9) & (angle < 4.5 - 1e-9)
    z = np.where(gap, z * TURN[np.where(np.isin(lead, (2, 3)), 1, 5)], z)
    side = np.where(np.angle(z) / (np.pi / 3) % 6 < 4, 3, 5)  # of the gap, as far as it is near
    middle = pent & (np.abs(z) < 1e-12)
    to = z + far / beta
    missing = middle & (np.abs(np.angle(to * np.conj(TURN[MISSING]))) < np.pi / 6 - 1e-9)
    face, at, _ = _on_faces(base, side, to)
    return face, at, ~missing


def neighbours(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``h`` and ids of their neighbours, six or five each."""
    rows, ids = [], []
    for k in range(6):
        face, at, there = _beside(h, TURN[k])
        res = (h >> 52) & 15
        for r in np.unique(res[there]):
            pick = np.flatnonzero(there & (res == r))
            rows.append(pick)
            ids.append(from_plane(face[pick], *_nearest(at[pick] * scale(int(r))), int(r)))
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *ids])


def disks(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``h``, ids of the cells at most k steps away, and their number of steps."""
    row, ids, far = np.arange(len(h)), h.copy(), np.zeros(len(h), np.int64)
    front = (row, ids)
    for step in range(1, k + 1):
        at, near = neighbours(front[1])
        found = np.unique(np.stack([front[0][at], near]), axis=1)
        seen = np.stack([row, ids])
        both = np.concatenate([seen, found], axis=1)
        _, first = np.unique(both, axis=1, return_index=True)
        new = np.sort(first[first >= seen.shape[1]]) - seen.shape[1]
        front = (found[0][new], found[1][new])
        row, ids, far = np.concatenate([row, front[0]]), np.concatenate([ids, front[1]]), np.concatenate([far, np.full(len(new), step)])
    return row, ids, far


def outlines(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``h``, and longitudes and latitudes of their corners, counter-clockwise."""
    rows, lng, lat = [], [], []
    for k in range(6):
        face, at, there = _beside(h, TURN[k] * np.exp(1j * np.pi / 6) / 3**0.5)
        x, y = _degrees(grid().point(face, at))
        rows.append(np.where(there, np.arange(len(h)), -1))
        lng.append(x)
        lat.append(y)
    row, lng, lat = (np.stack(x, 1).ravel() for x in (rows, lng, lat))
    return row[row >= 0], lng[row >= 0], lat[row >= 0]


def areas(h: np.ndarray) -> np.ndarray:
    """Areas on the unit sphere, corners joined by great circles: triangles from the centre to each side."""
    row, lng, lat = outlines(h)
    corner = xyz(np.radians(lat), np.radians(lng))
    x, y = centres(h)
    middle = xyz(np.radians(y), np.radians(x))[row]
    start = np.searchsorted(row, np.arange(len(h)))
    following = np.arange(len(row)) + 1
    last = np.append(start[1:], len(row)) - 1
    following[last] = start
    b, c = corner, corner[following]
    turn = np.abs(np.sum(middle * np.cross(b, c), 1))
    flat = 1 + np.sum(middle * b, 1) + np.sum(b * c, 1) + np.sum(c * middle, 1)
    return np.bincount(row, 2 * np.arctan2(turn, flat), len(h))
