"""Words and labels: plurals, byte and time formats, file stems, source kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IRREGULAR = {"person": "persons", "bus": "buses", "knife": "knives", "mouse": "mice", "sheep": "sheep", "skis": "skis"}
IMAGE_SUFFIXES = ("bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp")
VIDEO_SUFFIXES = ("avi", "flv", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "webm", "wmv")


def plural(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word.endswith(("s", "x", "ch", "sh")):
        return word + "es"
    if word.endswith("y") and word[-2:] not in ("ey", "ay", "oy"):
        return word[:-1] + "ies"
    return word + "s"


def pluralize(word: Column) -> Column:
    """plural() as an expression."""
    out = F.when(word.rlike("(s|x|ch|sh)$"), F.concat(word, F.lit("es"))).when(word.rlike("y$") & ~word.rlike("[eao]y$"), F.concat(F.substring(word, F.lit(1), F.length(word) - 1), F.lit("ies")))
    out = out.otherwise(F.concat(word, F.lit("s")))
    for one, many in IRREGULAR.items():
        out = F.when(word == one, F.lit(many)).otherwise(out)
    return out


def counted(n: Column, name: Column) -> Column:
    """"1 bus", "2 buses"."""
    return F.concat_ws(" ", n.cast("string"), F.when(n > 1, pluralize(name)).otherwise(name))


def suffix(path: Column) -> Column:
    """The lower-cased part behind the last dot of the last path element; empty without one, or if only the name's first character is a dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1))


def is_image_url(url: Column) -> Column:
    """Whether a URL, without what follows a question mark, ends in an image suffix."""
    return suffix(F.substring_index(F.lower(url), "?", 1)).isin(*IMAGE_SUFFIXES)


def source_kind(uri: Column) -> Column:
    """webcam, image_url, stream, glob, video or image: the first that fits, in this order. Directories take a file system to tell."""
    web = uri.startswith("http://") | uri.startswith("https://")
    return (
        F.when(uri.rlike(r"^\+?[0-9]{1,10}$") & (uri.try_cast("bigint") <= 4294967295), "webcam")
        .when(web & is_image_url(uri), "image_url")
        .when(web | uri.startswith("rtsp://") | uri.startswith("rtmp://"), "stream")
        .when(uri.contains("*"), "glob")
        .when(suffix(uri).isin(*VIDEO_SUFFIXES), "video")
        .otherwise("image")
    )


def is_image_kind(kind: Column) -> Column:
    return kind.isin("image", "image_url")


def is_video_kind(kind: Column) -> Column:
    """Whether frames follow each other: video files, cameras and streams."""
    return kind.isin("video", "webcam", "stream")


def is_batch_kind(kind: Column) -> Column:
    """Whether there are many images."""
    return kind.isin("directory", "glob", "image_list")


def output_stem(path: Column, frame_idx: Column, total_frames: Column) -> Column:
    """A class map's file stem: the image's own if it is the only frame, else with the frame number in six digits."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.when(name == "", "frame").otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    return F.when(total_frames == 1, stem).otherwise(F.format_string("%s_%06d", stem, frame_idx))


def frame_name(path: Column, frame_idx: Column) -> Column:
    """Where a video's frame is saved: a folder named after the video, frames counted from 1."""
    stem = output_stem(path, F.lit(0), F.lit(1))
    return F.format_string("%s_frames/%s_%d.jpg", stem, stem, frame_idx + 1)


def model_file(path: Column) -> Column:
    """A model's path with the suffix .onnx in lower case, added if there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(~name.contains("."), F.concat(path, F.lit(".onnx"))).when(path.rlike(r"(?i)\.onnx$"), F.regexp_replace(path, r"(?i)\.onnx$", ".onnx")).otherwise(path)


def format_bytes(n: Column) -> Column:
    x = n.cast("double")
    return F.when(x >= 1 << 30, F.format_string("%.1fGB", x / (1 << 30))).when(x >= 1 << 20, F.format_string("%.1fMB", x / (1 << 20))).when(x >= 1 << 10, F.format_string("%.1fKB", x / (1 << 10))).otherwise(F.format_string("%.0fB", x))


def format_time(seconds: Column) -> Column:
    s = seconds.cast("double")
    minutes = F.floor(F.pmod(s, F.lit(3600.0)) / 60).cast("int")
    rest = F.format_string("%04.1f", F.pmod(s, F.lit(60.0)))
    short = F.concat(F.floor(s / 60).cast("int").cast("string"), F.lit(":"), rest)
    long = F.concat(F.floor(s / 3600).cast("int").cast("string"), F.lit(":"), F.format_string("%02d", minutes), F.lit(":"), rest)
    return F.when(s < 60, F.format_string("%.1fs", s)).when(s < 3600, short).otherwise(long)


def progress_bar(progress: Column, width: int = 12) -> Column:
    full = F.least(F.floor(progress * width).cast("int"), F.lit(width))
    return F.concat(F.repeat(F.lit("━"), full), F.repeat(F.lit("─"), width - full))


def progress_line(done: Column, total: Column, elapsed: Column, width: int = 12) -> Column:
    """A download's state in one line; without a known total only amount, speed and time."""
    speed = F.concat(format_bytes(F.when(elapsed > 0, done / elapsed).otherwise(F.lit(0.0))), F.lit("/s"))
    share = F.least(done / total, F.lit(1.0))
    whole = F.concat(F.format_string("%3d%%", F.floor(share * 100).cast("int")), F.lit(" "), progress_bar(share, width), F.lit(" "), format_bytes(done), F.lit("/"), format_bytes(total))
    return F.concat(F.lit("  "), F.concat_ws(" ", F.when(total == 0, format_bytes(done)).otherwise(whole), speed, format_time(elapsed)))
