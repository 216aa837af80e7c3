"""What the screens of a project show: labels, hit tests, chart frames and orders, as SQL text for both engines.

Inputs are derived as in ``queries`` (see FIXTURES.md): samples from part, photos in time from events, objects from embeddings.
"""

from __future__ import annotations

#: Samples with a kind, a photo and a tap on it.
SAMPLES = (
    "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'paper' ELSE 'bean' END AS kind, p_name AS label, p_partkey % 40 AS photo_id, "
    "CAST(p_partkey * 37 % 1500 AS DOUBLE) AS tap_x, CAST(p_partkey * 53 % 600 AS DOUBLE) AS tap_y, CASE p_partkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'M' ELSE 'L' END AS tap_size FROM part"
)
#: Samples spread over fewer photos than there are: squares leave out half of the remainders.
SPREAD = "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'paper' ELSE 'bean' END AS kind, p_partkey * p_partkey % 53 AS photo_id FROM part"
#: Labels under a prefix: with a number, with something else behind the prefix, without the prefix, without a label, and one prefix that no label has.
LABELS = "SELECT concat(p_brand, ' ') AS prefix, CASE p_size % 4 WHEN 0 THEN concat(p_brand, ' ', CAST(p_size AS VARCHAR(10))) WHEN 1 THEN concat(p_brand, ' x', CAST(p_size AS VARCHAR(10))) WHEN 2 THEN p_name END AS label FROM part UNION ALL SELECT '#' AS prefix, p_name AS label FROM part"
#: Objects of a photo with a place, a size, a group and coordinates on two principal axes.
PLACED = (
    "SELECT vec_id {div} 50 AS photo_id, vec_id AS object_id, CAST(vec_id % 50 * 30 AS DOUBLE) AS cx, CAST(vec_id * 91 % 600 AS DOUBLE) AS cy, CAST(12 + vec_id % 9 AS DOUBLE) AS rx, "
    "CAST(vec_id % 4 AS INT) AS grp, 60 * CAST({e1} AS DOUBLE) AS px, 60 * CAST({e2} AS DOUBLE) AS py FROM embeddings"
)
#: Whites of photos in time: the basis is missing for some, the tap for others.
PHOTOS = (
    "SELECT event_id AS id, user_id AS project, ts AS created, CASE event_type WHEN 'view' THEN 'tapped' WHEN 'click' THEN 'borrowed' WHEN 'purchase' THEN 'camera' END AS basis, "
    "CASE WHEN event_id % 3 = 0 THEN 1e0 END AS white_x FROM events"
)
# Tap radius by size as a share of the long edge, letters of groups, the plot's width by height, least width of a plot, reach of a tap.
_RADIUS = "CASE tap_size WHEN 'S' THEN 0.006e0 WHEN 'M' THEN 0.012e0 ELSE 0.025e0 END"
_LETTER = "substr('ABCDEF', grp + 1, 1)"
_ASPECT = "1.45e0"
_LONG_EDGE, _SCREEN = "1600e0", "390e0"

# Names that are suggested, in their order.
FLAVORS = (
    "A&W Cream Soda", "A&W Root Beer", "Berry Blue", "Blueberry", "Bubble Gum", "Buttered Popcorn", "Cantaloupe", "Cappuccino", "Caramel Corn", "Chocolate Pudding", "Cinnamon", "Coconut",
    "Cotton Candy", "Crushed Pineapple", "Dr Pepper", "French Vanilla", "Green Apple", "Island Punch", "Juicy Pear", "Kiwi", "Lemon Drop", "Lemon Lime", "Licorice", "Mango", "Margarita",
    "Mixed Berry Smoothie", "Orange Sherbet", "Peach", "Piña Colada", "Plum", "Pomegranate", "Raspberry", "Red Apple", "Sizzling Cinnamon", "Sour Cherry", "Strawberry Cheesecake",
    "Strawberry Daiquiri", "Strawberry Jam", "Sunkist Lemon", "Sunkist Lime", "Sunkist Orange", "Sunkist Pink Grapefruit", "Sunkist Tangerine", "Toasted Marshmallow", "Top Banana",
    "Tutti-Fruitti", "Very Cherry", "Watermelon", "Wild Blackberry",
)
SUGGESTED = 12


def flavor_table() -> str:
    """The suggested names with their places."""
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{name}')" for i, name in enumerate(FLAVORS)) + ") AS f(position, name)"


def suggestions(typed: str, measured: str) -> str:
    """The first suggestions for each text of ``typed``: names that contain it, those that start with it first, and names of ``measured`` (in lower case) last of all."""
    rank = "CASE WHEN m.name IS NULL THEN 0 ELSE 2 END + CASE WHEN substr(lower(f.name), 1, char_length(query)) = query THEN 0 ELSE 1 END"
    return (
        f"SELECT typed, name, place FROM (SELECT typed, f.name, row_number() OVER (PARTITION BY typed ORDER BY {rank}, position) AS place FROM (SELECT typed, lower(trim(typed)) AS query FROM ({typed}) AS t) AS t "
        f"JOIN ({flavor_table()}) AS f ON query = '' OR position(query IN lower(f.name)) > 0 LEFT JOIN ({measured}) AS m ON m.name = lower(f.name)) AS s WHERE place <= {SUGGESTED}"
    )


TEXTS: dict[str, str] = {
    # Typed: nothing, the first two letters of every part, and a word with blanks around it; measured: the names at the places of even part sizes.
    "flavor_suggestions": suggestions("SELECT DISTINCT substr(p_name, 1, 2) AS typed FROM part UNION SELECT '' AS typed UNION SELECT '  Berry ' AS typed", f"SELECT DISTINCT lower(name) AS name FROM part JOIN ({flavor_table()}) AS f ON position = p_size WHERE p_size % 2 = 0"),
    # Lookups by id: the photo of a sample, none if its photo is gone.
    "photo_of_sample": f"SELECT s.id, s.photo_id, p.created FROM ({SAMPLES}) AS s LEFT JOIN ({PHOTOS}) AS p ON p.id = s.photo_id",
    # Radius on the photo, the tap on the screen, and the whole point of the screen under it back on the photo.
    "tap_marks": f"SELECT id, round({_RADIUS} * {_LONG_EDGE}, 6) AS radius, round(tap_x * scale, 6) AS screen_x, round(tap_y * scale, 6) AS screen_y, round(floor(tap_x * scale) / scale, 5) AS back_x, round(floor(tap_y * scale) / scale, 5) AS back_y FROM (SELECT *, {_SCREEN} / {_LONG_EDGE} AS scale FROM ({SAMPLES}) AS s) AS s",
    # Neighbours along x take turns above and below; long names are cut.
    "tap_labels": f"SELECT id, photo_id, CASE WHEN char_length(label) > 16 THEN concat(substr(label, 1, 15), '…') ELSE label END AS shown, kind = 'bean' AND (row_number() OVER (PARTITION BY photo_id, kind ORDER BY tap_x, id) - 1) % 2 = 1 AS below FROM ({SAMPLES}) AS s",
    # The nearest object whose reach covers the tap; none gives no row.
    "tap_hits": f"SELECT id, object_id, round(far, 6) AS far FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, object_id) AS place FROM (SELECT s.id, o.object_id, o.rx, sqrt((o.cx - s.tap_x) * (o.cx - s.tap_x) + (o.cy - s.tap_y) * (o.cy - s.tap_y)) AS far FROM ({SAMPLES}) AS s JOIN ({PLACED}) AS o ON s.photo_id = o.photo_id) AS d WHERE far < 1.3e0 * rx) AS h WHERE place = 1",
    # Equal scales on both axes, a fifth of room, never under six units across.
    "chart_domain": f"SELECT photo_id, round(mx - height * {_ASPECT} / 2e0, 6) AS x_from, round(mx + height * {_ASPECT} / 2e0, 6) AS x_to, round(my - height / 2e0, 6) AS y_from, round(my + height / 2e0, 6) AS y_to FROM (SELECT photo_id, (min(px) + max(px)) / 2e0 AS mx, (min(py) + max(py)) / 2e0 AS my, greatest((max(px) - min(px)) * 1.2e0 / {_ASPECT}, (max(py) - min(py)) * 1.2e0, 6e0 / {_ASPECT}) AS height FROM ({PLACED}) AS o GROUP BY photo_id) AS d",
    # Up to four groups are lettered above their topmost object.
    "chart_letters": f"SELECT photo_id, {_LETTER} AS letter, round(x, 6) AS x, round(top, 6) AS top FROM (SELECT photo_id, grp, avg(px) AS x, max(py) AS top, count(*) OVER (PARTITION BY photo_id) AS groups FROM ({PLACED}) AS o GROUP BY photo_id, grp) AS g WHERE groups BETWEEN 2 AND 4",
    "photos_newest_first": f"SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY created DESC, id DESC) AS place FROM ({PHOTOS}) AS p",
    "white_basis": f"SELECT id, basis, basis IN ('tapped', 'found') AS measured FROM (SELECT id, coalesce(basis, CASE WHEN white_x IS NULL THEN 'found' ELSE 'tapped' END) AS basis FROM ({PHOTOS}) AS p) AS p",
    "samples_by_kind": f"SELECT photo_id, kind, count(*) AS samples, count(DISTINCT label) AS labels, min(id) AS first_id FROM ({SAMPLES}) AS s GROUP BY photo_id, kind",
    # Photos that hold objects but no measured bean.
    "photos_without_beans": f"SELECT DISTINCT o.photo_id FROM ({PLACED}) AS o LEFT JOIN (SELECT DISTINCT photo_id FROM ({SPREAD}) AS s WHERE kind = 'bean') AS b ON o.photo_id = b.photo_id WHERE b.photo_id IS NULL",
    # One more than the largest number behind each prefix; 1 where no label has a number.
    "next_label_numbers": f"SELECT prefix, coalesce(max(CASE WHEN substr(label, 1, char_length(prefix)) = prefix THEN TRY_CAST(substr(label, char_length(prefix) + 1) AS INT) END), 0) + 1 AS next_number FROM ({LABELS}) AS l GROUP BY prefix",
}
