"""Errors of the service, each with its code."""

from __future__ import annotations


class ServiceError(RuntimeError):
    code = -1


# Error codes of the service protocol.
class InternalError(ServiceError):
    code = 0x0001


class ExternalError(ServiceError):
    code = 0x0002


class OutOfMemoryError(ServiceError):
    code = 0x0004


class FileSystemError(ServiceError):
    code = 0x0008


class RequestError(ServiceError):
    code = 0x0010


class ConfigError(ServiceError):
    code = 0x0020


class PluginError(ServiceError):
    code = 0x0040


class PermissionDenied(ServiceError):
    code = 0x0080


class Unsupported(ServiceError):
    code = 0x0100


class ProxyBackendError(ServiceError):
    code = 0x0200


class KeyExistsError(ServiceError):
    code = 0x0400
