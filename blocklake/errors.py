"""What reading and writing compressed data can raise."""


class XzError(Exception):
    """Any failure of the codec; unsupported filters raise it as such."""


class XzFormatError(XzError):
    """The bytes are not of the format: magic, reserved flags, property bytes."""


class XzDataError(XzError):
    """The bytes are damaged: checksums, sizes, padding, truncation."""


class XzLimitError(XzError):
    """The output would exceed the limit that the caller set."""
