"""Repositories before they are read: jobs of a command line, clones and their cache, finding inputs.

All of this runs on the driver and moves files only; reading is files.read_repos.
"""

from __future__ import annotations

import argparse
import contextlib
import glob
import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field


@dataclass
class Jobs:
    """What a command line asks for: repositories with their branch (None: the default), folders of repositories."""

    repos: list[tuple[str, str | None]] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)
    cache_dir: str | None = None


def read_list(text: str) -> tuple[list[tuple[str, str | None]], list[str]]:
    """(jobs, lines with words too many) of a list: 'url [branch]' a line, # begins a comment."""
    jobs, extra = [], []
    for line in text.splitlines():
        words = re.sub(r"(^|\s)#.*$", "", line).split()
        if words:
            jobs.append((words[0], words[1] if len(words) > 1 else None))
            if len(words) > 2:
                extra.append(line)
    return jobs, extra


class _Branch(argparse.Action):
    """A branch belongs to the repository named last."""

    def __call__(self, parser, namespace, values, option_string=None):
        if not namespace.repos:
            parser.error(f"{option_string} must follow a repository")
        namespace.repos[-1] = (namespace.repos[-1][0], values)


class _Repo(argparse.Action):
    def __call__(self, parser, namespace, values, option_string=None):
        namespace.repos = [*(namespace.repos or []), (values, None)]


def parse_jobs(argv: Sequence[str]) -> Jobs:
    """Jobs of `url [--branch b] ... [--repos-file f] [--cache-dir d] [--master-folder m]`."""
    p = argparse.ArgumentParser(add_help=False)
    p.set_defaults(repos=[])
    p.add_argument("--repo", dest="repos", action=_Repo, default=[])
    p.add_argument("--branch", "-b", action=_Branch, dest="repos_branch")
    p.add_argument("--repos-file", "-f", action="append", default=[])
    p.add_argument("--cache-dir", "-c")
    p.add_argument("--master-folder", "-m", action="append", default=[])
    takes_value = {"--branch", "-b", "--repos-file", "-f", "--cache-dir", "-c", "--master-folder", "-m", "--repo"}
    # a bare word is a repository: named like an option, it keeps its place before its branch
    spelled, skip = [], False
    for word in argv:
        if skip or word.startswith("-"):
            spelled.append(word)
            skip = not skip and word in takes_value
        else:
            spelled += ["--repo", word]
    got = p.parse_args(spelled)
    jobs = Jobs(list(got.repos), [os.path.normpath(m) for m in got.master_folder], got.cache_dir)
    for path in got.repos_file:
        with open(path, encoding="utf-8") as f:
            jobs.repos += read_list(f.read())[0]
    return jobs


def name_of(url: str) -> str:
    """Last segment of an address without .git."""
    return re.sub(r"\.git$", "", url.rstrip("/").rpartition("/")[2])


def is_url(place: str) -> bool:
    return bool(re.match(r"https?://", place)) or place.endswith(".git")


def clone(url: str, into: str, branch: str | None = None) -> str:
    """A shallow clone of a repository; raises CalledProcessError if git fails."""
    more = ["--branch", branch] if branch else []
    subprocess.run(["git", "clone", "--quiet", "--depth", "1", *more, "--", url, into], check=True, capture_output=True)
    return into


def cached(url: str, cache_dir: str | None) -> str | None:
    """The folder of a repository in the cache, if it is there."""
    place = os.path.join(cache_dir, name_of(url)) if cache_dir else None
    return place if place and os.path.isdir(place) else None


@contextlib.contextmanager
def checkout(place: str, branch: str | None = None, cache_dir: str | None = None, keep: bool = False) -> Iterator[str]:
    """A local folder of a repository: the folder itself, its cached copy, or a clone.

    A clone is put into the cache if `keep`, else into a folder that is removed at the end, also after an error.
    """
    if not is_url(place):
        if not os.path.isdir(place):
            raise FileNotFoundError(place)
        yield place
        return
    known = cached(place, cache_dir)
    if known:
        yield known
        return
    work = tempfile.mkdtemp(prefix="loomgraph-clone-")
    try:
        got = clone(place, os.path.join(work, "repo"), branch)
        if keep and cache_dir:
            os.makedirs(cache_dir, exist_ok=True)
            # moved when it is whole: a broken clone never looks like a cached one
            got = shutil.move(got, os.path.join(cache_dir, name_of(place)))
        yield got
    finally:
        shutil.rmtree(work, ignore_errors=True)


def locate(url: str, roots: Sequence[str], known: dict[str, str] | None = None) -> str | None:
    """Where a repository lies: a known place of its address (with or without .git or slash), else a root's folder of its name."""
    for key in dict.fromkeys((url, url.rstrip("/"), re.sub(r"\.git/?$", "", url), url + ".git")):
        place = (known or {}).get(key)
        if place and os.path.isdir(place):
            return place
    return next((p for r in roots if os.path.isdir(p := os.path.join(r, name_of(url)))), None)


def only_match(patterns: str | Sequence[str], explicit: str | None = None) -> str:
    """The one file of the patterns; an explicit path goes first. None or several are an error that names them."""
    if explicit:
        if not os.path.exists(explicit):
            raise FileNotFoundError(explicit)
        return explicit
    found = sorted({m for p in ([patterns] if isinstance(patterns, str) else patterns) for m in glob.glob(p)})
    if len(found) != 1:
        raise ValueError(f"one file expected for {patterns}, found {found}")
    return found[0]
