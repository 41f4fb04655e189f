"""Hand-encoded ONNX model (protobuf wire format; the onnx package is absent).

Input ``numeric_features`` float[N, 6]; outputs: p_purchase = mean, p_churn =
max, p_engagement = min, p_inactivity = L1 norm over the features (float[N]);
the four class heads are the features themselves (float[N, 6])."""


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        b = n & 0x7F
        n >>= 7
        out.append(b | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _f(num: int, value) -> bytes:
    if isinstance(value, int):
        return _varint(num << 3) + _varint(value)
    if isinstance(value, str):
        value = value.encode()
    return _varint((num << 3) | 2) + _varint(len(value)) + value


def _attr_ints(name, values):
    return b"".join([_f(1, name), *[_f(8, v) for v in values], _f(20, 7)])


def _attr_int(name, value):
    return _f(1, name) + _f(3, value) + _f(20, 2)


def _node(op, inp, out, attrs=()):
    return _f(1, inp) + _f(2, out) + _f(3, out + "_node") + _f(4, op) + b"".join(_f(5, a) for a in attrs)


def _value_info(name, dims):
    shape = b"".join(_f(1, _f(2, d) if isinstance(d, str) else _f(1, d)) for d in dims)
    tensor = _f(1, 1) + _f(2, shape)  # elem_type FLOAT
    return _f(1, name) + _f(2, _f(1, tensor))


def model_bytes() -> bytes:
    x = "numeric_features"
    red = [_attr_ints("axes", [1]), _attr_int("keepdims", 0)]
    nodes = [_node("ReduceMean", x, "p_purchase", red), _node("ReduceMax", x, "p_churn", red),
             _node("ReduceMin", x, "p_engagement", red), _node("ReduceL1", x, "p_inactivity", red),
             _node("Identity", x, "p_next_event"), _node("Identity", x, "p_channel"),
             _node("Identity", x, "p_action"), _node("Identity", x, "p_active_period")]
    outs = [("p_purchase", ["N"]), ("p_churn", ["N"]), ("p_engagement", ["N"]), ("p_inactivity", ["N"]),
            ("p_next_event", ["N", 6]), ("p_channel", ["N", 6]), ("p_action", ["N", 6]),
            ("p_active_period", ["N", 6])]
    graph = (b"".join(_f(1, n) for n in nodes) + _f(2, "g") + _f(11, _value_info(x, ["N", 6]))
             + b"".join(_f(12, _value_info(n, d)) for n, d in outs))
    return _f(1, 7) + _f(8, _f(1, "") + _f(2, 13)) + _f(7, graph)
