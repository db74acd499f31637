"""Errors of requests and indexes, with the HTTP status a server would answer."""

from __future__ import annotations


class SearchError(Exception):
    status = 500


class InvalidRequest(SearchError):
    """A request that can't be parsed or doesn't fit the index."""

    status = 400


class MappingConflict(SearchError):
    """A document that doesn't fit the mapping."""

    status = 400


class NotFound(SearchError):
    """An index, document or snapshot that isn't there."""

    status = 404


class AlreadyExists(SearchError):
    status = 409


class LimitExceeded(SearchError):
    """More indexes or documents than the store allows."""

    status = 429
